"""The position of each row in a statement's own order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import settled


def with_pos(df: DataFrame, pos: str = "_pos", settle: bool = True) -> DataFrame:
    """df with each row's place from 0, in the order in which df returns its rows.

    The statement runs once. Rows are numbered within their partition, and each partition's number of rows, one small
    row each, says where the next one begins; no task sees all rows.
    """
    numbered = df.withColumn("_mid", F.monotonically_increasing_id())
    if settle:
        numbered = settled(numbered)
    part = F.shiftright("_mid", 33)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = numbered.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(pos, F.col("_before") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid", "_part", "_before")
