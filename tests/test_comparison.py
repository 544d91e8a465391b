"""Comparison operators against a plain Counter, and by hand-made results."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import keys
from plumbline.operators import multiset, ordered, readings
from plumbline.operators.mechanism import mechanism
from plumbline.operators.order import with_pos
from plumbline.plans.audit import compare

NAN, INF = float("nan"), float("inf")


def typed(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float) and v != v:
        return ("dec", "NaN")
    return ("dec" if isinstance(v, float | Decimal) else "str", v)


def random_rows(r, n):
    return [(r.choice([None, 1, 2]), r.choice([None, 0.0, -0.0, 1.5, NAN, INF]), r.choice([None, "", "NULL", "a\tb", "a\nb", "é"]), r.choice([None, True, False]), r.choice([None, Decimal("1.00"), Decimal("1.10")])) for _ in range(n)]


SCHEMA = "a int, b double, c string, d boolean, e decimal(10,2)"


@pytest.mark.parametrize("seed", range(5))
def test_multisets_are_those_of_a_counter(spark, seed):
    r = random.Random(seed)
    x = random_rows(r, 60)
    y = list(x) if seed == 0 else x[: r.randrange(60)] + random_rows(r, r.randrange(20))
    r.shuffle(y)
    a, b = (Counter(tuple(map(typed, row)) for row in rows) for rows in (x, y))
    gold, second = spark.createDataFrame(x, SCHEMA), spark.createDataFrame(y, SCHEMA)
    v = multiset.verdict(gold, second).first()
    assert v["equal"] == (a == b) and v["same_set"] == (set(a) == set(b))
    assert (v["gold_distinct"], v["second_distinct"], v["shared_distinct"]) == (len(a), len(b), len(set(a) & set(b)))
    assert (v["gold_only_rows"], v["second_only_rows"]) == (sum((a - b).values()), sum((b - a).values()))
    held = multiset.difference(gold, second).collect()
    assert sum(d["n"] for d in held if d["side"] == "gold") == sum((a - b).values())
    assert {d["n"] for d in held if d["side"] == "second"} == set((b - a).values())
    assert multiset.repeated(gold).count() == sum(n > 1 for n in a.values())


def test_types_and_values_make_different_keys(spark):
    frames = [spark.sql(f"SELECT {x} AS v") for x in ("1", "1L", "true", "'1'", "1.0D", "CAST(1 AS DECIMAL(5,1))", "NULL", "'NULL'")]
    ks = [keys.by_place(df).select(keys.row_key(keys.by_place(df)).alias("k")).first()["k"][0] for df in frames]
    assert ks == ["int:1", "int:1", "bool:true", "str:1", "dec:1", "dec:1", "null:", "str:NULL"]
    assert not multiset.verdict(frames[0], frames[4]).first()["equal"]
    assert multiset.verdict(spark.sql("SELECT CAST(1 AS DECIMAL(5,1)) v"), spark.sql("SELECT CAST(1 AS DECIMAL(9,4)) v")).first()["equal"]
    assert not multiset.verdict(spark.sql("SELECT CAST('x' AS STRING) v WHERE false"), spark.sql("SELECT 1 v WHERE false")).first()["equal"]
    with pytest.raises(keys.UnsupportedValue):
        multiset.verdict(spark.sql("SELECT array(1) v"), spark.sql("SELECT array(1) v"))
    bad = spark.sql("SELECT CAST(X'ff' AS STRING) AS v UNION ALL SELECT 'ff'")
    assert multiset.counts(bad).count() == 2


def test_canonical_text(spark):
    def line(sql):
        df = keys.by_place(spark.sql(f"SELECT {sql}"))
        return df.select(keys.canonical_line(df).alias("x")).first()["x"]

    assert line("CAST(2.0000005 AS DECIMAL(10,7)), -0.0D, 1e21D") == "dec:2.000001\tdec:0.000000\tdec:1000000000000000000000.000000"
    assert line("CAST('NaN' AS DOUBLE), CAST('-Infinity' AS DOUBLE), NULL") == "dec:NaN\tdec:-Infinity\tnull:NULL"
    assert line("'a\\tb\\\\c\\nd', true, DATE '2020-02-03'") == "str:a\\tb\\\\c\\nd\tbool:true\tdate:2020-02-03"
    assert line("TIMESTAMP '2020-02-03 04:05:06'") == "ts:2020-02-03T04:05:06.000000Z"
    assert line("TIMESTAMP_NTZ '2020-02-03 04:05:06'") == "ts_ntz:2020-02-03T04:05:06.000000"


def placed(spark, rows, schema="a int, b string"):
    return with_pos(spark.createDataFrame(rows, schema).coalesce(1))


def test_positions_are_the_statement_order(spark):
    df = with_pos(spark.range(1000).repartition(7).orderBy(F.desc("id")))
    assert all(r["_pos"] == 999 - r["id"] for r in df.collect())


def test_sequences(spark):
    x = [(1, "a"), (2, "b"), (2, "b"), (3, "c")]
    v = lambda y: ordered.verdict(placed(spark, x), placed(spark, y)).first()
    assert v(x)["equal"] and v(x)["first_difference"] is None
    assert v([x[1], x[0], *x[2:]])["first_difference"] == 0
    assert v(x[:2])["prefix"] and not v(x[:2])["equal"] and not v(x[1:3])["prefix"] and not v([])["prefix"]
    near = ordered.verdict(placed(spark, [(1.00000001, "a"), (2.0, "b")], "a double, b string"), placed(spark, [(1.00000002, "a")], "a double, b string")).first()
    assert near["first_difference"] == 1 and not near["prefix"]
    many = [(i, str(i)) for i in range(50)]
    told = [ordered.digest(placed(spark, rows), ["a"], block=7) for rows in (many, many, many[::-1], many[:49], [*many[:6], many[7], many[6], *many[8:]])]
    assert told[0] == told[1] and len(set(told)) == 4
    places = {r["gold_pos"]: r["second_pos"] for r in ordered.place_map(placed(spark, x), placed(spark, [x[2], x[0], x[1]])).collect()}
    assert places == {0: 1, 1: 0, 2: 2, 3: None}
    assert ordered.digest(placed(spark, x), ["a"]) == ordered.digest(placed(spark, x), ["a"]) != ordered.digest(placed(spark, x[:2]), ["a"])


def test_plain_set_equality(spark):
    def says(x, y):
        return readings.set_reading(spark.sql(x), spark.sql(y)).first()["agrees"]

    assert says("SELECT 1 v", "SELECT 1.0D v") and says("SELECT true v", "SELECT 1 v") and says("SELECT 1 v UNION ALL SELECT 1", "SELECT 1 v")
    assert says("SELECT 0.5D v", "SELECT CAST(0.5 AS DECIMAL(5,2)) v") and not says("SELECT 0.1D v", "SELECT CAST(0.1 AS DECIMAL(5,2)) v")
    assert not says("SELECT CAST('NaN' AS DOUBLE) v", "SELECT CAST('NaN' AS DOUBLE) v") and not says("SELECT 1 v", "SELECT 1 v, 2 w")
    assert says("SELECT 1 v WHERE false", "SELECT 1 v, 2 w WHERE false") and not says("SELECT '1' v", "SELECT 1 v")


def test_orders_of_columns(spark):
    x, y = "SELECT 1 a, 'x' b, 2 c UNION ALL SELECT 3, 'y', 4", "SELECT 'x' b, 2 c, 1 a UNION ALL SELECT 'y', 4, 3"
    says = lambda a, b, o=False: readings.permuted_reading(spark.sql(a), spark.sql(b), o)
    assert says(x, y) and not says(x, "SELECT 'x' b, 4 c, 1 a UNION ALL SELECT 'y', 2, 3") and not says(x, "SELECT 1 a")
    assert says("SELECT 1 a WHERE false", "SELECT 1 a, 2 b WHERE false")
    a, b = (with_pos(spark.sql(f"SELECT * FROM ({s}) ORDER BY 1")) for s in (x, "SELECT 1 c, 'x' d, 2 e UNION ALL SELECT 3, 'y', 4"))
    assert readings.permuted_reading(a, b, True) and not readings.permuted_reading(a, with_pos(spark.sql(f"SELECT * FROM ({x}) ORDER BY 1 DESC")), True)
    with pytest.raises(readings.PermutationBudget):
        readings.permuted_reading(spark.sql(x), spark.sql(y), False, budget=1)


def test_orders_of_columns_are_those_of_brute_force(spark):
    import itertools
    import random
    from collections import Counter

    r = random.Random(16)
    for trial in range(6):
        width, n = r.randrange(1, 5), r.randrange(1, 6)
        rows = [tuple(r.randrange(3) for _ in range(width)) for _ in range(n)]
        order = r.sample(range(width), width)
        other = [tuple(x[i] for i in order) for x in r.sample(rows, n)]
        if trial % 2:
            at = r.randrange(n)
            other[at] = tuple(r.randrange(3) for _ in range(width))
        names = ", ".join(f"c{i} int" for i in range(width))
        a, b = spark.createDataFrame(rows, names), spark.createDataFrame(other, names)
        want = any(Counter(rows) == Counter(tuple(x[i] for i in p) for x in other) for p in itertools.permutations(range(width)))
        assert readings.permuted_reading(a, b, False) == want, trial
        placed_ = [placed(spark, x, names) for x in (rows, other)]
        want = any(rows == [tuple(x[i] for i in p) for x in other] for p in itertools.permutations(range(width)))
        assert readings.permuted_reading(*placed_, True) == want, trial


def test_all_orders_of_eight_columns_are_one_job(spark, monkeypatch):
    rows = [tuple((i * (k + 1) + k * k) % 11 for k in range(8)) for i in range(110)]
    names = ", ".join(f"c{i} int" for i in range(8))
    asked, jobs = [], []
    monkeypatch.setattr(readings, "_alike", lambda g, s, orders, o, f=readings._alike: (jobs.append(len(orders)), f(g, s, orders, o))[1])
    monkeypatch.setattr(readings, "_unequal", lambda *a, f=readings._unequal: (asked.append(1), f(*a))[1])
    a = spark.createDataFrame(rows, names)
    assert readings.permuted_reading(a, spark.createDataFrame([(x[7], *x[1:7], x[0]) for x in rows], names), False)
    assert jobs == [40320] and len(asked) <= 1 + 8
    # the same values in each row and each column, but never the same rows
    jobs.clear(), asked.clear()
    turned = [tuple(x[(k + i // 11) % 8] for k in range(8)) for i, x in enumerate(rows)]
    assert not readings.permuted_reading(a, spark.createDataFrame(turned, names), False)
    assert len(asked) == 1 and sum(jobs) == 40320
    with pytest.raises(readings.PermutationBudget):
        readings.permuted_reading(a, spark.createDataFrame(turned, names), False, budget=110 * 40319)


def test_other_readings(spark):
    ts = "SELECT TIMESTAMP '2020-01-01 10:00:00' v"
    assert readings.dates_as_text_reading(spark.sql(ts), spark.sql("SELECT DATE '2020-01-01' v")).first()["agrees"] == 1
    assert readings.dates_as_text_reading(spark.sql("SELECT 1 v WHERE false"), spark.sql("SELECT 1 v WHERE false")).first()["agrees"] == 0
    a, b = placed(spark, [(1.234, "x")], "a double, b string"), placed(spark, [(1.2301, "x")], "a double, b string")
    assert readings.rounded_ordered_reading(a, b).first()["agrees"] == 1
    assert readings.column_existence_reading(a.select("_pos", "a"), b).first()["agrees"] == 1
    assert readings.column_existence_reading(b, a.select("_pos", "a")).first()["agrees"] == 0
    assert readings.named_columns_reading(spark.sql("SELECT 1 a, 2 b"), spark.sql("SELECT 2 b, 1 a")).first()["agrees"] == 1


@pytest.mark.parametrize(
    ("gold", "second", "rule", "want"),
    [
        ("SELECT id FROM range(5) ORDER BY id", "SELECT id FROM range(5) ORDER BY id", "ordered", (True, None)),
        ("SELECT id FROM range(5) ORDER BY id", "SELECT id FROM range(5) ORDER BY id DESC", "ordered", (False, "order")),
        ("SELECT id FROM range(5) ORDER BY id", "SELECT id FROM range(5) ORDER BY id LIMIT 2", "ordered", (False, "truncation")),
        ("SELECT id FROM range(5)", "SELECT id FROM range(5) UNION ALL SELECT 1", "set", (False, "multiplicity")),
        ("SELECT id FROM range(5)", "SELECT CAST(id AS STRING) AS id FROM range(5)", "set", (False, "type")),
        ("SELECT id FROM range(5)", "SELECT id + 100 AS id FROM range(5)", "set", (False, "other")),
        ("SELECT id FROM range(5)", "SELECT id FROM range(5) WHERE id IN (4, 1)", "set", (False, "truncation")),
        ("SELECT id FROM range(5)", "SELECT 4 - id AS n FROM range(5)", "set", (True, None)),
    ],
)
def test_why_results_differ(spark, gold, second, rule, want):
    row = compare(spark.sql(gold), spark.sql(second), rule).first()
    assert (row["equal"], row["mechanism"]) == want


def test_mechanism_precedence(spark):
    flags = spark.createDataFrame([(False, True, True, True, True), (True, True, True, True, True), (True, True, True, True, False), (True, False, True, True, True), (True, False, False, True, True), (True, False, False, False, True)], "t boolean, b boolean, s boolean, p boolean, o boolean")
    got = [r["m"] for r in flags.select(mechanism(*(F.col(c) for c in "tbspo")).alias("m")).collect()]
    assert got == ["type", "order", "other", "multiplicity", "truncation", "other"]


def test_text_types(spark):
    assert keys.declared_type(T.DecimalType(10, 2)) == keys.declared_type(T.DecimalType(5, 1)) == "decimal"
    assert keys.declared_type(T.VarcharType(3)) == "string" and keys.is_text(T.CharType(2))


def test_columns_of_one_name_are_told_apart_by_place(spark):
    a = with_pos(spark.sql("SELECT id AS v, id % 2 AS v, 1.5D AS v FROM range(4) ORDER BY id"))
    b = with_pos(spark.sql("SELECT id AS v, 0L AS v, 1.501D AS v FROM range(4) ORDER BY id"))
    assert ordered.verdict(a, a).first()["equal"] and ordered.verdict(a, b).first()["first_difference"] == 0
    assert ordered.place_map(a, a).where("gold_pos <> second_pos").count() == 0
    assert readings.rounded_ordered_reading(a, a).first()["agrees"] == 1 and readings.rounded_ordered_reading(a, b).first()["agrees"] == 0
    assert readings.column_existence_reading(a, a).first()["agrees"] == 1 and readings.column_existence_reading(a, b).first()["agrees"] == 0
    assert readings.permuted_reading(a, a, True) and not readings.permuted_reading(a, b, True)
    twice = with_pos(spark.sql("SELECT 1 AS v, 'x' AS v FROM range(3)"))
    assert [(r["n"], r["first_pos"]) for r in multiset.repeated(twice, "_pos").collect()] == [(3, 0)]
    assert multiset.repeated(a, "_pos").isEmpty()
