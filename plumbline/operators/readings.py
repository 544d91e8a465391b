"""What looser public comparators would say of two results."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import keys
from plumbline.operators.order import with_pos

#: Fixed value: rows that the search for an order of columns may compare.
PERMUTATION_BUDGET = 20_000_000


class PermutationBudget(RuntimeError):
    """The search for an order of columns would compare more rows than allowed."""


def set_reading(gold: DataFrame, second: DataFrame) -> DataFrame:
    """One row: agrees (1 or 0) and distinct rows of each side, under plain set equality of rows. A row with NaN
    equals no row, so that each counts as distinct and any makes the answer 0."""
    rows = []
    for side, df in enumerate((gold, second)):
        own = keys.by_place(df)
        rows.append(own.select(keys.set_row_key(own).alias("key"), keys.has_nan(own).alias("nan"), F.lit(side).alias("side")))
    per_key = rows[0].unionAll(rows[1]).groupBy("key", "nan").agg(F.count_if(F.col("side") == 0).alias("g"), F.count_if(F.col("side") == 1).alias("s"))
    seen = lambda c: F.when(F.col("nan"), F.col(c)).otherwise((F.col(c) > 0).cast("long"))
    width = len(gold.columns) == len(second.columns)
    out = per_key.agg(F.coalesce(F.bool_and((F.col("g") > 0) == (F.col("s") > 0)), F.lit(True)).alias("same"), F.coalesce(F.bool_or("nan"), F.lit(False)).alias("nan"), F.coalesce(F.sum(seen("g")), F.lit(0)).alias("gold_distinct"), F.coalesce(F.sum(seen("s")), F.lit(0)).alias("second_distinct"), F.count("*").alias("n"))
    agrees = F.col("same") & ~F.col("nan") & (F.lit(width) | (F.col("n") == 0))
    return out.select(agrees.cast("int").alias("agrees"), "gold_distinct", "second_distinct")


def _value_keys(df: DataFrame) -> DataFrame:
    own = keys.by_place(df)
    return own.select(*(F.coalesce(keys.set_reading_key(F.col(f.name), f.dataType), F.lit("null:")).alias(f.name) for f in own.schema.fields))


def _contained(gold: DataFrame, second: DataFrame, width: int) -> list[list[int]]:
    """For each column of gold the columns of second all of whose values it has. One aggregation for all columns."""
    cells = lambda df, side: df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.col(f"c{i}").alias("v")) for i in range(width)))).alias("x"), F.lit(side).alias("side"))
    by_value = cells(gold, 0).unionAll(cells(second, 1)).groupBy("x.v").agg(F.collect_set(F.when(F.col("side") == 0, F.col("x.place"))).alias("g"), F.collect_set(F.when(F.col("side") == 1, F.col("x.place"))).alias("s"))
    places = F.array(*(F.lit(i) for i in range(width)))
    missing = by_value.select(F.explode("s").alias("j"), F.array_except(places, "g").alias("absent")).select("j", F.explode("absent").alias("i")).distinct().collect()  # width squared at most
    refused = {(r["i"], r["j"]) for r in missing}
    return [[j for j in range(width) if (i, j) not in refused] for i in range(width)]


def permuted_reading(gold: DataFrame, second: DataFrame, ordered: bool, budget: int = PERMUTATION_BUDGET) -> bool:
    """Whether the results agree under some order of second's columns: as sequences if ordered (then both carry
    _pos), else as multisets. Two empty results agree; different counts or widths don't.

    Columns are paired only where a column's values are among the other's; each complete order costs its rows. All
    orders that this leaves are held against gold by checksums in one job, and those that agree by their rows.
    """
    own = [df.drop("_pos") for df in (gold, second)]
    n = [df.count() for df in own]
    if n[0] != n[1]:
        return False
    if n[0] == 0:
        return True
    width = len(own[0].columns)
    if width != len(own[1].columns):
        return False
    g, s = (_value_keys(df) for df in own)
    if ordered:
        g, s = (k.select("*") for k in (g, s))
        g, s = (_value_keys(df.drop("_pos")).select("*") if "_pos" not in df.columns else _placed(df) for df in (gold, second))
    loose = lambda df: F.array_sort(F.array(*(F.col(f"c{i}") for i in range(width))))
    if _unequal(g, s, loose(g), loose(s), ordered):
        return False
    options, spent, rows = _contained(g, s, width), 0, n[0]

    def orders(i: int, used: tuple[int, ...]):
        if i == width:
            yield used
            return
        for j in options[i]:
            if j not in used:
                yield from orders(i + 1, (*used, j))

    left, most = orders(0, ()), budget // rows
    names = lambda order: F.array(*(F.col(f"c{j}") for j in order))
    while some := list(islice(left, min(ORDERS_AT_A_TIME, most - spent))):
        spent += len(some)
        for i in _alike(g, s, some, ordered):
            if not _unequal(g, s, names(range(width)), names(some[i]), ordered):
                return True
    if next(left, None) is not None:
        raise PermutationBudget(f"more than {budget} rows would be compared")
    return False


def _checksums(df: DataFrame, orders: list[tuple[int, ...]], ordered: bool, first: int) -> DataFrame:
    """(order, a, b): of each order of df's columns, numbered from first, two sums over all rows of a hash of the row in
    that order, its place included if ordered. They don't depend on how rows are dealt. df has keys as text."""
    width = len(orders[0])
    sent = df.sparkSession.sparkContext.broadcast(np.array(orders, np.int8))
    hashed = df.select(*(F.xxhash64(f"c{i}").alias(f"h{i}") for i in range(width)), *([F.xxhash64("_pos").alias("place")] if ordered else []))

    def sums(batches):
        at = sent.value
        total = np.zeros((2, len(at)), np.uint64)
        for batch in batches:
            cells = np.stack([batch.column(f"h{i}").to_numpy().view(np.uint64) for i in range(width)])
            place = batch.column("place").to_numpy().view(np.uint64) if ordered else np.zeros(batch.num_rows, np.uint64)
            # rows and orders at a time, so that a task holds a few million hashes
            for few in range(0, len(at), 2048):
                part = at[few : few + 2048]
                for row in range(0, batch.num_rows, 1024):
                    own, here = cells[:, row : row + 1024], place[row : row + 1024]
                    for k, odd in enumerate(_ODD):
                        h = np.broadcast_to(here, (len(part), len(here))).copy()
                        for i in range(width):
                            h = h * odd + own[part[:, i]]
                        h ^= h >> np.uint64(29)
                        h *= odd
                        h ^= h >> np.uint64(32)
                        total[k, few : few + len(part)] += h.sum(axis=1, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(at))), *(pa.array(t.view(np.int64)) for t in total)], ["order", "a", "b"])

    return hashed.mapInArrow(sums, "order long, a long, b long")


#: Orders of columns whose checksums are worked out by one job, and what their hashes multiply by.
ORDERS_AT_A_TIME = 50_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _alike(g: DataFrame, s: DataFrame, orders: list[tuple[int, ...]], ordered: bool) -> list[int]:
    """Those of orders, by number, in which the checksums of second's rows are gold's: one aggregation of both sides.
    Rows that agree have equal checksums; that equal ones agree is for the caller to make sure."""
    width = len(orders[0])
    every = _checksums(g, [tuple(range(width))], ordered, -1).unionAll(_checksums(s, orders, ordered, 0))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = {r["order"]: (int(r["a"]) % (1 << 64), int(r["b"]) % (1 << 64)) for r in every.groupBy("order").agg(wide("a"), wide("b")).collect()}  # a row an order
    return sorted(i for i, sums in found.items() if i >= 0 and sums == found[-1])


def test_suite_reading(gold: DataFrame, second: DataFrame, gold_sql: str, budget: int = PERMUTATION_BUDGET) -> int | None:
    """1 or 0: the results agree under some order of columns, in order if the gold's text holds `order by` anywhere.
    None where the search for an order of columns is beyond its budget."""
    in_order = "order by" in gold_sql.lower()
    sides = [with_pos(df) for df in (gold, second)] if in_order else [gold, second]
    try:
        return int(permuted_reading(*sides, in_order, budget))
    except PermutationBudget:
        return None


#: Not a test, whatever pytest makes of its name.
test_suite_reading.__test__ = False


def _placed(df: DataFrame) -> DataFrame:
    own = keys.by_place(df.drop("_pos"))
    return keys.by_place_but(df, "_pos").select("_pos", *(F.coalesce(keys.set_reading_key(F.col(f.name), f.dataType), F.lit("null:")).alias(f.name) for f in own.schema.fields))


def _unequal(g: DataFrame, s: DataFrame, gold_key: Column, second_key: Column, ordered: bool) -> bool:
    if ordered:
        a, b = g.select("_pos", gold_key.alias("a")), s.select("_pos", second_key.alias("b"))
        return not a.join(b, "_pos", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
    rows = g.select(gold_key.alias("k"), F.lit(1).alias("n")).unionAll(s.select(second_key.alias("k"), F.lit(-1).alias("n")))
    return not rows.groupBy("k").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()


def dates_as_text_reading(gold: DataFrame, second: DataFrame) -> DataFrame:
    """Set equality after dates become text, where an empty side never agrees. One row: agrees."""

    def plain(df):
        own = keys.by_place(df)
        return own.select(*(F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType) else F.col(f.name) for f in own.schema.fields))

    both = set_reading(plain(gold), plain(second))
    return both.select((F.col("agrees") * F.when((F.col("gold_distinct") > 0) & (F.col("second_distinct") > 0), 1).otherwise(0)).alias("agrees"))


def rounded_ordered_reading(gold: DataFrame, second: DataFrame, places: int = 2) -> DataFrame:
    """Equality in order after numbers are rounded half up. Both carry _pos. One row: agrees."""

    def rounded(df, name):
        own = keys.by_place(df.drop("_pos"))
        cells = [F.round(f.name, places).cast("double") if isinstance(f.dataType, T.DecimalType | T.DoubleType | T.FloatType) else F.col(f.name) for f in own.schema.fields]
        kinds = [T.DoubleType() if isinstance(f.dataType, T.DecimalType | T.DoubleType | T.FloatType) else f.dataType for f in own.schema.fields]
        return keys.by_place_but(df, "_pos").select("_pos", F.array(*(F.coalesce(keys.set_reading_key(c, k), F.lit("null:")) for c, k in zip(cells, kinds, strict=True))).alias(name))

    both = rounded(gold, "a").join(rounded(second, "b"), "_pos", "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).cast("int").alias("agrees"))


def named_columns_reading(gold: DataFrame, second: DataFrame) -> DataFrame:
    """Set equality with columns in the order of their names; different names never agree. One row: agrees."""
    if sorted(gold.columns) != sorted(second.columns):
        return gold.sparkSession.createDataFrame([(0,)], "agrees int")
    return set_reading(gold.select(*sorted(gold.columns)), second.select(*sorted(second.columns))).select("agrees")


def column_existence_reading(gold: DataFrame, second: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whether for each column of gold some column of second holds its values, place by place, numbers within a
    tolerance and nulls as 0. Both carry _pos. One row: agrees."""
    a, b = (df.toDF(*(c.replace("c", p) for c in keys.by_place_but(df, "_pos").columns)) for df, p in ((gold, "a"), (second, "b")))
    left, right = ([f for f in df.schema.fields if f.name != "_pos"] for df in (a, b))

    def near(x, y):
        numeric = [isinstance(f.dataType, T.NumericType) for f in (x, y)]
        if all(numeric):
            return F.abs(F.coalesce(F.col(x.name).cast("double"), F.lit(0.0)) - F.coalesce(F.col(y.name).cast("double"), F.lit(0.0))) <= tolerance
        if any(numeric):
            return F.lit(False)
        return F.coalesce(F.col(x.name).cast("string"), F.lit("0")) == F.coalesce(F.col(y.name).cast("string"), F.lit("0"))

    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "_pos", "full_outer")
    present = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    held = both.agg(*(F.coalesce(F.bool_and(present & near(x, y)), F.lit(True)).alias(f"{x.name}_{y.name}") for x in left for y in right))
    each = F.lit(True)
    for x in left:
        some = F.lit(False)
        for y in right:
            some = some | F.col(f"{x.name}_{y.name}")
        each = each & some
    return held.select(each.cast("int").alias("agrees"))
