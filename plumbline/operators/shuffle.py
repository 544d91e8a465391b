"""Copies of tables in another storage order, which a statement reads in place of the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.scratch import settled, unsettle

#: Fixed value: tables of more rows aren't copied.
ROW_LIMIT = 300_000


def shuffled(df: DataFrame, seed: str) -> DataFrame:
    """df's rows in an order that the seed and the rows decide, held so that no plan can undo it.

    The order is spread over as many partitions as a shuffle has; a statement meets them in that order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    return settled(df.withColumn("_by", F.sha2(F.concat(F.lit(f"{seed}:"), cells), 256)).repartitionByRange(parts, "_by").sortWithinPartitions("_by").drop("_by"))


@dataclass
class Copies:
    """made: tables that have a copy; skipped: those with more rows than the limit, and qualified names, which a
    temporary view doesn't stand in for."""

    spark: SparkSession
    made: dict[str, DataFrame]
    skipped: dict[str, str]

    def reaches(self, tables: tuple[str, ...]) -> list[str]:
        known = {t.lower() for t in self.made}
        return [t for t in tables if t.lower() in known]

    def drop(self) -> None:
        """Drops the views and the files of the copies; frames that read them can't be used afterwards."""
        for name, df in self.made.items():
            self.spark.catalog.dropTempView(name)
            unsettle(df)


def prepare(spark: SparkSession, tables: tuple[str, ...], seed: str, row_limit: int = ROW_LIMIT) -> Copies:
    """A session of its own whose unqualified names are shuffled copies of the tables of spark."""
    from plumbline.plans.session import PINNED, view

    own = spark.newSession()
    for k, v in PINNED.items():
        own.conf.set(k, v)
    made, skipped = {}, {}
    for name in tables:
        if "." in name:
            skipped[name] = "qualified"
            continue
        df = spark.table(name)
        if df.limit(row_limit + 1).count() > row_limit:
            skipped[name] = "rows"
            view(own, df, name)
            continue
        made[name] = shuffled(df, seed)
        view(own, made[name], name)
    return Copies(own, made, skipped)


def float_sums(df: DataFrame, value: str, orders: int = 4) -> DataFrame:
    """(read_order, total) of a column's sum read in several orders by one task each, and so in exactly that order.

    Sums of floats depend on the order; the experiment is meant for small tables."""
    held = []
    for i in range(orders):
        rows = settled(df.select(value).repartition(1).sortWithinPartitions(F.sha2(F.concat(F.lit(f"{i}:"), F.col(value).cast("string")), 256)))
        held.append(rows.agg(F.sum(value).alias("total")).select(F.lit(i).alias("read_order"), "total"))
    out = held[0]
    for x in held[1:]:
        out = out.unionAll(x)
    return out
