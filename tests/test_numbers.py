"""Numbers of any size in canonical text and under set equality, against Python's decimal."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import keys
from plumbline.plans import audit

EDGES = [0.0, -0.0, 1e40, -1e40, 1e308, -1.7976931348623157e308, 5e-324, 1e-7, 5e-7, -5e-7, 4.9999995e-1, 999999.9999995, 9.9999999e31, 1e32, 1e31, 123456789.0, 1e18, 1e19, 1e20, 1e22, 1e23, 9007199254740993.0, 2.0**63, 2.0**64, 2.0**100, 2.0**126, 2.0**127, 1e37, 1e38, 0.1, 0.5, 0.000244140625, 1e10, 1e100, 123.4567895, float("inf"), float("-inf"), float("nan"), None]


def doubles():
    r = random.Random(7)
    return EDGES + [r.uniform(-1, 1) * 10.0 ** r.randrange(-12, 45) for _ in range(300)] + [float(r.randrange(-(10**6), 10**6)) * 2.0 ** r.randrange(-20, 100) for _ in range(300)]


def decimals(scale):
    with localcontext() as c:
        c.prec = 99
        return _decimals(scale)


def _decimals(scale):
    r = random.Random(scale)
    own = [Decimal(r.randrange(-(10 ** r.randrange(1, 39)), 10 ** r.randrange(1, 39))).scaleb(-scale) for _ in range(300)]
    own += [Decimal(10**38 - 1).scaleb(-scale), Decimal(0).scaleb(-scale), Decimal(1).scaleb(-scale), None]
    if 6 <= scale <= 20:
        own += [Decimal(r.randrange(-(10**12), 10**12)) / 2 ** r.randrange(0, 7) for _ in range(200)]
    if scale < 20:
        own += [Decimal(2) ** k for k in range(0, 60)] + [Decimal("100000000000000000"), Decimal("4503599627370497")]
    return own


def canonical(v, text):
    if v is None:
        return "NULL"
    if isinstance(v, float) and not math.isfinite(v):
        return "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    with localcontext() as c:
        c.prec = 999
        q = Decimal(text).quantize(Decimal("0.000001"), ROUND_HALF_UP)
    return format(abs(q) if q == 0 else q, "f")


def frame(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))


@pytest.mark.parametrize("scale", [None, 0, 2, 6, 18, 37])
def test_canonical_text_is_that_of_decimal(spark, scale):
    kind, values = (T.DoubleType(), doubles()) if scale is None else (T.DecimalType(38, scale), decimals(scale))
    df = frame(spark, values, kind)
    rows = {r["i"]: r for r in df.select("i", keys.rendered(F.col("v"), kind).alias("t"), F.col("v").cast("string").alias("own")).collect()}
    # of a double the digits are those of Spark's own text, which gives the same double but isn't always the shortest
    assert all(v is None or v != v or float(rows[i]["own"].replace("Infinity", "inf")) == v for i, v in enumerate(values) if isinstance(v, float))
    assert [rows[i]["t"] for i in range(len(values))] == [canonical(v, rows[i]["own"]) for i, v in enumerate(values)]


def test_typed_keys_tell_numbers_of_all_sizes_apart(spark):
    values = sorted({v for v in doubles() if v is not None and math.isfinite(v)})
    df = frame(spark, values, T.DoubleType())
    got = {r["i"]: r["k"] for r in df.select("i", keys.cell_key(F.col("v"), T.DoubleType()).alias("k")).collect()}
    assert len(set(got.values())) == len(values)
    assert all(float(got[i].removeprefix("dec:")) == v for i, v in enumerate(values)) and not any("E" in k for k in got.values())


def test_set_keys_agree_just_where_python_does(spark):
    held = [(v, T.DoubleType()) for v in doubles()] + [(v, T.DecimalType(38, s)) for s in (0, 2, 7, 18, 37) for v in decimals(s)]
    r = random.Random(3)
    for v in [v for v in doubles() if v is not None and math.isfinite(v) and 1e-6 < abs(v) < 1e37]:
        with localcontext() as c:
            c.prec = 999
            exact = Decimal(v)
            for s in (0, 2, 18):
                near = exact.quantize(Decimal(1).scaleb(-s)) + r.choice([0, 0, 1]) * Decimal(1).scaleb(-s)
                if abs(near) < Decimal(10) ** (38 - s):
                    held.append((near, T.DecimalType(38, s)))
    held += [(v, T.LongType()) for v in (0, 1, -5, 2**62, 2**53 + 1, 10**18)] + [(True, T.BooleanType()), (False, T.BooleanType())]
    held.append((Decimal("4503599627370497.25"), T.DecimalType(38, 2)))
    held.append((4503599627370497.25, T.DoubleType()))
    by_kind, found = {}, {}
    for i, (v, kind) in enumerate(held):
        by_kind.setdefault(kind, []).append((i, v))
    for kind, own in by_kind.items():
        df = frame(spark, [v for _, v in own], kind)
        for row in df.select("i", keys.set_reading_key(F.col("v"), kind).alias("k")).collect():
            found[own[row["i"]][0]] = row["k"]
    of_key, of_value = {}, {}
    for i, (v, _) in enumerate(held):
        if v is None or v != v:
            continue
        of_key.setdefault(found[i], set()).add(v)
        of_value.setdefault(v, set()).add(found[i])  # Python's equality and hash of numbers
    assert all(len(k) == 1 for k in of_value.values()), [x for x in of_value.items() if len(x[1]) > 1][:5]
    assert all(len(v) == 1 for v in of_key.values()), [x for x in of_key.items() if len(x[1]) > 1][:5]


def test_results_with_wide_numbers_compare(spark):
    wide = spark.sql("SELECT CAST('1e40' AS DOUBLE) AS a, CAST('123456789012345678901234567890.25' AS DECIMAL(38,2)) AS b")
    for rule in ("set", "ordered"):
        assert audit.compare(wide, wide, rule).first()["equal"]
        assert not audit.compare(wide, wide.selectExpr("a * 10 AS a", "b"), rule).first()["equal"]
    ten, hundred = spark.sql("SELECT 1e10D AS v"), spark.sql("SELECT 1e100D AS v")
    assert not audit.compare(ten, hundred, "set").first()["equal"]
    # 1e23 as a double is no power of ten
    assert audit.compare(spark.sql("SELECT 1e22D AS v"), spark.sql("SELECT CAST('1e22' AS DECIMAL(38,0)) AS v"), "set").first()["set_reading"] == 1
    assert audit.compare(spark.sql("SELECT 1e23D AS v"), spark.sql("SELECT CAST('1e23' AS DECIMAL(38,0)) AS v"), "set").first()["set_reading"] == 0
