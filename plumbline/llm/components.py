"""Connected components of a graph given as a table of edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.llm.store import materialise


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges written to the shared folder, and their number and a checksum, taken while they are written."""
    seen = Observation()
    held = materialise(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return held, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that can be reached.

    Alternates two star contractions. In the first each node hands all its larger neighbours to its smallest
    neighbour; in the second each node hands its smaller neighbours to the smallest. Both keep connectivity, and the
    edges end as stars around each component's smallest node. A round is a pre-aggregated minimum and a join on the
    same key, which adaptive execution splits where one node has most of the edges. Each round is written to the
    shared folder. An empty table of edges gives an empty result; null ends are ignored.
    """
    held = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held, was = _written(held)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = held.union(held.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        held, now = _written(small)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(held.select(F.col("v"), F.col("v")).distinct())
