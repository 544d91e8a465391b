"""What the data was when statements ran: schema, counts, content, and cheap signs of change."""

from __future__ import annotations

import hashlib
import json
import os
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import keys


def schema_rows(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str, bool]]:
    """(table, place, column, type, nullable), in order."""
    return [(name, i, f.name, f.dataType.simpleString(), f.nullable) for name in sorted(tables) for i, f in enumerate(tables[name].schema.fields)]


def schema_digest(tables: dict[str, DataFrame]) -> str:
    return hashlib.sha256(json.dumps(schema_rows(tables)).encode()).hexdigest()


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows), counted in one job."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionAll(one)
    return out


def content_digest(df: DataFrame) -> DataFrame:
    """One row: rows, and two checksums of typed rows that don't depend on their order, so that each task adds up its
    own and nothing is sorted: a sum and an exclusive or of 64-bit hashes."""
    own = keys.by_place(df)
    h = F.xxhash64(keys.row_key(own))
    return own.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"))


def two_copies(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows, other_rows, same) of the tables of two copies: same where the typed rows are, whatever their
    order. A table that one copy lacks has null rows there and isn't the same. Without any table, a ValueError."""
    name = lambda df, t: content_digest(df).withColumn("table_name", F.lit(t))
    every = sorted({*a, *b})
    if not every:
        raise ValueError("no table in either copy")
    held = []
    for tables in (a, b):
        rows = [name(tables[t], t) for t in every if t in tables]
        held.append(reduce(DataFrame.unionByName, rows) if rows else name(next(iter({**a, **b}.values())), "").limit(0))
    both = held[0].alias("x").join(held[1].alias("y"), "table_name", "full_outer")
    same = F.coalesce((F.col("x.rows") == F.col("y.rows")) & (F.col("x.sum") == F.col("y.sum")) & (F.col("x.xor") == F.col("y.xor")), F.lit(False))
    return both.select("table_name", F.col("x.rows").alias("rows"), F.col("y.rows").alias("other_rows"), same.alias("same"))


def document_digest(df: DataFrame) -> str:
    """sha256 over the rows' canonical text in sorted order; rows are streamed to the driver in that order."""
    h = hashlib.sha256()
    own = keys.by_place(df)
    for row in own.select(keys.canonical_line(own).alias("line")).orderBy("line").toLocalIterator():
        h.update(row["line"].encode() + b"\n")
    return h.hexdigest()


def content_signal(df: DataFrame) -> str | None:
    """A digest of the input files' names, sizes and times, from their listing, without a job: it changes when files do,
    and can miss a rewrite in place that keeps all three. None where the rows come from no files."""
    spark, files = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        files.append([name, status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps(files).encode()).hexdigest() if files else None


def planner_statistics(spark: SparkSession, table: str) -> dict[str, str]:
    """What the catalog says of a table."""
    return {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r["col_name"] and not r["col_name"].startswith("#")}


def storage_class_census(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, integers, reals, texts): what text columns hold, for all columns in one scan."""
    integer, real = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.\d*|\.\d+|\d+(\.\d*)?[eE][+-]?\d+)\s*$"
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    v = F.col("v")
    return cells.groupBy("column_name").agg(
        F.count_if(v.isNull()).alias("nulls"),
        F.count_if(F.rlike(v, F.lit(integer))).alias("integers"),
        F.count_if(F.rlike(v, F.lit(real))).alias("reals"),
        F.count_if(v.isNotNull() & ~F.rlike(v, F.lit(integer)) & ~F.rlike(v, F.lit(real))).alias("texts"),
    )


def typing_census(*results: DataFrame) -> DataFrame:
    """One row: distinct rows of all results by typed keys and by plain values; they differ where types alone part rows."""
    own = [keys.by_place(df) for df in results]
    rows = reduce(DataFrame.unionAll, [df.select(keys.row_key(df).alias("typed"), keys.set_row_key(df).alias("plain")) for df in own])
    return rows.agg(F.count_distinct("typed").alias("typed"), F.count_distinct("plain").alias("plain"))


class Cache:
    """Measured fixtures by key, in one JSON file; an entry of another signal, or that can't be read, is a miss."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _read(self) -> dict:
        try:
            held = json.loads(self.path.read_text())
            return held if isinstance(held, dict) else {}
        except (OSError, ValueError):
            return {}

    def get(self, key: str, signal: str) -> dict | None:
        entry = self._read().get(key)
        return entry["value"] if isinstance(entry, dict) and entry.get("signal") == signal and isinstance(entry.get("value"), dict) else None

    def put(self, key: str, signal: str, value: dict) -> None:
        held = self._read() | {key: {"signal": signal, "value": value}}
        temporary = self.path.with_name(f"{self.path.name}.{os.getpid()}")
        temporary.write_text(json.dumps(held, sort_keys=True))
        os.replace(temporary, self.path)


def measure(tables: dict[str, DataFrame], contents: bool = False, cache: Cache | None = None) -> dict:
    """{schema, counts, contents}: contents by table, measured only if asked for. With a cache each table is looked up by
    its name, schema and depth, and measured anew where its files have changed or it has none."""
    counts, measured, missing = {}, {}, {}
    for name, df in sorted(tables.items()):
        key = hashlib.sha256(json.dumps([name, schema_digest({name: df}), contents]).encode()).hexdigest()
        signal = content_signal(df) if cache else None
        held = cache.get(key, signal) if signal else None
        if held:
            counts[name], measured[name] = held["rows"], held["contents"]
        else:
            missing[name] = (key, signal)
    if missing:
        counts |= {r["table_name"]: r["rows"] for r in row_counts({t: tables[t] for t in missing}).collect()}
        measured |= {t: content_digest(tables[t]).first().asDict() if contents else None for t in missing}
        for t, (key, signal) in missing.items():
            if signal:
                cache.put(key, signal, {"rows": counts[t], "contents": measured[t]})
    return {"schema": schema_digest(tables), "counts": {t: counts[t] for t in sorted(tables)}, "contents": {t: measured[t] for t in sorted(tables)} if contents else {}}


def same_fixture(a: dict, b: dict) -> bool:
    """Equal schema and counts, and equal contents where both have them."""
    return a["schema"] == b["schema"] and a["counts"] == b["counts"] and (not a["contents"] or not b["contents"] or a["contents"] == b["contents"])


