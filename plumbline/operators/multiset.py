"""Results as multisets of typed rows: equality, differences with counts, shared rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import keys


def counts(df: DataFrame) -> DataFrame:
    """(key, n) of the distinct typed rows."""
    df = keys.by_place(df)
    return df.groupBy(keys.row_key(df).alias("key")).agg(F.count("*").alias("n"))


def count_pairs(gold: DataFrame, second: DataFrame) -> DataFrame:
    """(key, gold, second): how often each distinct typed row is in either. One aggregation of both, without a join,
    so that a side's repeated rows are added up before they are moved."""
    sides = [keys.by_place(df) for df in (gold, second)]
    rows = [df.select(keys.row_key(df).alias("key"), F.lit(i).alias("side")) for i, df in enumerate(sides)]
    return rows[0].unionAll(rows[1]).groupBy("key").agg(F.count_if(F.col("side") == 0).alias("gold"), F.count_if(F.col("side") == 1).alias("second"))


def verdict(gold: DataFrame, second: DataFrame) -> DataFrame:
    """One row: equal, same_types, rows and distinct rows of each side, shared distinct rows, rows in either excess."""
    same = keys.declared_types(gold) == keys.declared_types(second)
    pairs = count_pairs(gold, second)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = pairs.agg(
        F.coalesce(F.bool_and(F.col("gold") == F.col("second")), F.lit(True)).alias("same_bag"),
        F.coalesce(F.bool_and((F.col("gold") > 0) == (F.col("second") > 0)), F.lit(True)).alias("same_set"),
        total("gold").alias("gold_rows"),
        total("second").alias("second_rows"),
        F.count_if(F.col("gold") > 0).alias("gold_distinct"),
        F.count_if(F.col("second") > 0).alias("second_distinct"),
        F.count_if((F.col("gold") > 0) & (F.col("second") > 0)).alias("shared_distinct"),
        total(F.greatest(F.col("gold") - F.col("second"), F.lit(0))).alias("gold_only_rows"),
        total(F.greatest(F.col("second") - F.col("gold"), F.lit(0))).alias("second_only_rows"),
    )
    return out.select(F.lit(same).alias("same_types"), "*", (F.lit(same) & F.col("same_bag")).alias("equal"))


def difference(gold: DataFrame, second: DataFrame) -> DataFrame:
    """(side, key, n): rows that a side has more often than the other, and how much more often."""
    pairs = count_pairs(gold, second).where("gold <> second")
    return pairs.select(F.when(F.col("gold") > F.col("second"), "gold").otherwise("second").alias("side"), "key", F.abs(F.col("gold") - F.col("second")).alias("n"))


def bounded_difference(gold: DataFrame, second: DataFrame, limit: int = 25) -> DataFrame:
    """Of each side's difference the most frequent rows, `limit` at most, for a report."""
    held = difference(gold, second)
    sides = [held.where(F.col("side") == s).orderBy(F.desc("n"), "key").limit(limit) for s in ("gold", "second")]
    return sides[0].unionAll(sides[1])


def shared_distinct(gold: DataFrame, second: DataFrame) -> DataFrame:
    return count_pairs(gold, second).where("gold > 0 AND second > 0").select("key")


def repeated(df: DataFrame, pos: str | None = None) -> DataFrame:
    """(key, n, first_pos) of typed rows that occur more than once. pos: a column of places, not part of the key."""
    rows = keys.by_place_but(df, pos) if pos else keys.by_place(df)
    key = keys.row_key(rows.drop("_pos"))
    first = F.min("_pos") if pos else F.lit(None).cast("long")
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), first.alias("first_pos")).where("n > 1")
