"""Results as sequences of canonical rows: equality in order, prefixes, and where rows have moved.

Both sides carry their place in a column _pos (see order.with_pos); all is joined on it, so that no side is gathered.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import keys


def lines(df: DataFrame, pos: str = "_pos", typed: bool = False) -> DataFrame:
    """(_pos, line): the canonical text of each row; typed: also key, its typed cells with exact values."""
    own = keys.by_place(df.drop(pos))
    return keys.by_place_but(df, pos).select("_pos", keys.canonical_line(own).alias("line"), *([keys.row_key(own).alias("key")] if typed else []))


def compared(gold: DataFrame, second: DataFrame) -> DataFrame:
    """(_pos, gold_line, second_line) over both sides' places."""
    return lines(gold).withColumnRenamed("line", "gold_line").join(lines(second).withColumnRenamed("line", "second_line"), "_pos", "full_outer")


def verdict(gold: DataFrame, second: DataFrame) -> DataFrame:
    """One row: equal, same_types, rows of each side, first differing place, and whether the shorter side, if it has
    any rows, is the head of the longer one. Equality is of canonical lines, a head of typed rows with exact values."""
    same = keys.declared_types(gold.drop("_pos")) == keys.declared_types(second.drop("_pos"))
    sides = (lines(df, typed=True).toDF("_pos", f"{side}_line", f"{side}_key") for df, side in ((gold, "gold"), (second, "second")))
    both = next(sides).join(next(sides), "_pos", "full_outer")
    differs = ~F.col("gold_line").eqNullSafe(F.col("second_line"))
    out = both.agg(
        F.min(F.when(differs, F.col("_pos"))).alias("first_difference"),
        F.count("gold_line").alias("gold_rows"),
        F.count("second_line").alias("second_rows"),
        F.count_if((F.col("gold_key") != F.col("second_key")) & F.col("gold_key").isNotNull() & F.col("second_key").isNotNull()).alias("unequal"),
    )
    shorter = F.least("gold_rows", "second_rows")
    return out.select(
        (F.lit(same) & F.col("first_difference").isNull()).alias("equal"),
        F.lit(same).alias("same_types"),
        "gold_rows",
        "second_rows",
        "first_difference",
        (F.lit(same) & (F.col("unequal") == 0) & (shorter > 0) & (F.col("gold_rows") != F.col("second_rows"))).alias("prefix"),
    )


def place_map(gold: DataFrame, second: DataFrame) -> DataFrame:
    """(gold_pos, second_pos): the k-th occurrence of a row in gold to the k-th in second; null where there is none."""
    nth = F.row_number().over(Window.partitionBy("line").orderBy("_pos"))
    a, b = (lines(df).withColumn("nth", nth).withColumnRenamed("_pos", f"{side}_pos") for df, side in ((gold, "gold"), (second, "second")))
    return a.join(b, ["line", "nth"], "left").select("gold_pos", "second_pos")


def mixed_columns(df: DataFrame) -> DataFrame:
    """(place, tags) of columns whose cells have more than one tag, null among them."""
    own = keys.by_place(df)
    tags = F.array(*(F.struct(F.lit(i).alias("place"), keys.type_tag(F.col(f.name), f.dataType).alias("tag")) for i, f in enumerate(own.schema.fields)))
    return own.select(F.explode(tags).alias("t")).select("t.*").groupBy("place").agg(F.array_sort(F.collect_set("tag")).alias("tags")).where(F.size("tags") > 1)


#: Rows that one digest of a block is of.
BLOCK = 4096


def digest(df: DataFrame, columns: list[str], block: int = BLOCK) -> str:
    """sha256 of a result in order: the columns' names, then the digest of each block of rows by place. Blocks are
    hashed where they are, and the driver hashes a line for each of them."""
    rows = lines(df).groupBy(F.expr(f"_pos div {block}").alias("block"))
    blocks = rows.agg(F.array_sort(F.collect_list(F.struct("_pos", "line"))).alias("rows"))
    held = blocks.select("block", F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), "\n").cast("binary"), 256).alias("h")).orderBy("block")
    h = hashlib.sha256("\t".join(columns).encode())
    for row in held.toLocalIterator():
        h.update(b"\n" + row["h"].encode())
    return h.hexdigest()
