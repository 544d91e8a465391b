"""Sharding along a Hilbert curve: rows that are near in several metadata dimensions come to lie in the same files.

Each dimension, of any type that has an order, is quantised to 2**bits cells of about equal weight, by exact quantiles
of all rows; the cells' place on the curve orders all rows, and the order is cut into shards, and those into runs, of
equal counts. A reader with bounds on any of the dimensions
then needs only the runs whose ranges meet them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from plumbline.llm import kernel as K
from plumbline.llm.store import materialise


@dataclass(frozen=True)
class Settings:
    dimensions: tuple[str, ...] = ("source", "lang", "n_chars")
    bits: int = 5
    shards: int = 8
    run_rows: int = 10_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells, each in [0, 2**bits). Dimensions times bits: 63 at most.

    Works down from the high bit: undoes each level's reflection and exchange of axes, Gray-codes the axes, and reads
    the bits of all axes in turn.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    if n * bits > 63:
        raise ValueError("dimensions times bits must be 63 at most")
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        t ^= np.where(x[n - 1] & q, q - 1, 0)
    x ^= t
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> level & 1)
    return out


def quantiles(docs: DataFrame, column: str, parts: int) -> list:
    """At most parts - 1 values, in order, that cut the rows with a value into parts of about equal count: the value of
    the row at each multiple of rows / parts. Exact, and the same however the rows are dealt: values are counted, the
    counted values are sorted by range, and a sum over partitions, one small row each, says where each begins."""
    spark = docs.sparkSession
    v = F.col(f"`{column}`")
    counted = docs.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "v").withColumn("part", F.spark_partition_id())
    held = materialise(dealt, "values")
    before = held.groupBy("part").agg(F.sum("n").alias("rows")).select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    total = held.agg(F.sum("n")).first()[0] or 0
    upto = held.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("v"))).join(F.broadcast(before), "part")
    end = F.col("before") + F.col("upto")
    # the value holds a multiple of total / parts among its rows
    cuts = upto.where(F.floor((end - F.col("n")) * parts / max(1, total)) < F.floor(end * parts / max(1, total))).select("v").orderBy("v").collect()
    return [r["v"] for r in cuts][: parts - 1]


def assign(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert, run) for each row of docs, and its dimensions
    as dim_<name>, from which manifest() prunes.

    size: UTF-8 bytes of the text plus 1, 1 for null. The law is rows: shards' counts are at most one apart. slot
    counts from 0 in each shard without gaps, along the curve; equal cells go by the text's checksum, then by doc_id.
    A null dimension is in the first cell; a null text has the checksum of the empty text. grown_shard is null, as
    the law isn't by key. Repeated rows each get a place. Two runs over the same rows give the same shards and slots,
    but for rows that are equal in all of this. Only narrow rows are moved, never texts. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession

    def cell(d: str):
        """Nulls first, then values up to the first bound, and so on."""
        bounds = [] if isinstance(docs.schema[d].dataType, NullType) else quantiles(docs, d, 1 << s.bits)
        if not bounds:
            return F.lit(0)
        own = F.col(f"`{d}`")
        literal = F.array(*(F.lit(x).cast(docs.schema[d].dataType) for x in bounds))
        return F.when(own.isNotNull(), F.size(F.filter(literal, lambda x: x < own))).otherwise(0)

    def place(batches):
        for batch in batches:
            where = np.stack([batch.column(f"_cell{i}").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(s.dimensions))], axis=1)
            where = np.clip(where, 0, (1 << s.bits) - 1)
            yield K.extended(batch, [f"_cell{i}" for i in range(len(s.dimensions))], {"hilbert": pa.array(hilbert_index(where, s.bits), pa.int64())})

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    named = [F.col(f"`{d}`").alias(f"dim_{d}") for d in s.dimensions]
    narrow = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *named, *(cell(d).alias(f"_cell{i}") for i, d in enumerate(s.dimensions)))
    kept = narrow.drop(*(f"_cell{i}" for i in range(len(s.dimensions))))
    keyed = materialise(narrow.mapInArrow(place, K.schema_with(kept, "hilbert long")), "hilbert")
    total = keyed.count()
    keys = ["hilbert", "text_crc32", "doc_id", "size"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 2_000_000)
    sorted_ = materialise(keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "hilbert-order")
    # one row per partition of the sorted table
    part = F.shiftright("_at", 33)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    ranked = sorted_.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.col("_at").bitwiseAND((1 << 33) - 1))
    shard = F.expr(f"(_rank * {s.shards}) div {max(1, total)}")
    slot = F.col("_rank") - F.expr(f"(shard * {total} + {s.shards - 1}) div {s.shards}")
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", slot.cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", F.expr(f"slot div {s.run_rows}").cast("int").alias("run"), *(f"dim_{d}" for d in s.dimensions))
    )


def manifest(rows: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Of each run its rows and, for each dimension, the least and the largest value (null without any) and the rows
    without one, for pruning. rows need shard, run and the dimensions; an empty table has no runs."""
    return rows.groupBy("shard", "run").agg(F.count("*").alias("rows"), *(f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)), *(F.count_if(F.col(f"`{d}`").isNull()).alias(f"nulls_{d}") for d in dimensions))


def runs_meeting(held: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Those runs of a manifest that can hold rows within all of bounds (dimension: (low, high), inclusive, None for
    no bound). A null is within no bounds, so that a run of nulls alone is left out."""
    for d, (low, high) in bounds.items():
        if high is not None:
            held = held.where(F.col(f"min_{d}") <= F.lit(high))
        if low is not None:
            held = held.where(F.col(f"max_{d}") >= F.lit(low))
    return held
