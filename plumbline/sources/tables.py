"""Tables: folders of Parquet files as databases, look-ups, and other formats."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, sql: str) -> None:
    """Temporary views of those tables that a statement names."""
    for name in TPCH:
        if re.search(rf"\b{name}\b", sql):
            table(spark, folder, name).createOrReplaceTempView(name)


def run(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    views(spark, folder, sql)
    return spark.sql(sql)


def folder_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder by name: each entry `name.parquet`, a file or a folder, on any file system of Spark's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise FileNotFoundError(f"no folder {folder}")
    names = sorted(str(f.getPath().getName()) for f in system.listStatus(path))
    found = {n.removesuffix(".parquet"): spark.read.parquet(f"{folder}/{n}") for n in names if n.endswith(".parquet")}
    if not found:
        raise FileNotFoundError(f"no Parquet tables in {folder}")
    return found


def register_database(spark: SparkSession, name: str, folder: str, tables: list[str]) -> None:
    """A database of external tables over Parquet files."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    for t in tables:
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}`.`{t}` USING parquet LOCATION '{folder}/{t}.parquet'")


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query's result from another engine, by one task. Credentials belong in options, not in the address."""
    refuse_credentials(url)
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_jdbc_table(spark: SparkSession, url: str, name: str, partition_column: str, partitions: int, bounds: tuple | None = None, fetch_rows: int = 10_000, **options: str) -> DataFrame:
    """A table of another engine, read by so many tasks, each a range of a column of numbers, dates or timestamps. bounds:
    where the first range ends and the last one begins lie between them; unless given, the engine is asked for the least
    and the largest value, which one task reads. No row is left out: the first range has all below and the nulls, the
    last all above. Filters and chosen columns go to the other engine.

    A table without a value in that column, so that nothing can be cut, is read by one task."""
    refuse_credentials(url)
    if partitions < 1:
        raise ValueError("at least one partition")
    own = {"url": url, "fetchsize": str(fetch_rows), **options}
    if bounds is None:
        least = spark.read.format("jdbc").options(query=f"SELECT min({partition_column}) AS low, max({partition_column}) AS high FROM {name}", **own).load().first()
        bounds = (least[0], least[1])
    reader = spark.read.format("jdbc").options(dbtable=name, **own)
    if partitions == 1 or bounds[0] is None or bounds[0] == bounds[1]:
        return reader.load()
    return reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)).load()


def jdbc_tables(spark: SparkSession, url: str, tables: dict[str, tuple[str, int]], **options: str) -> dict[str, DataFrame]:
    """Tables of another engine by name, as a run takes them: name to (column to cut at, tasks)."""
    return {name: read_jdbc_table(spark, url, name, column, n, **options) for name, (column, n) in tables.items()}


def refuse_credentials(target: str) -> None:
    """Refuses an address, or a list of keyword=value settings, that holds a password."""
    if re.search(r"://[^/@\s]*:[^/@\s]+@", target) or re.search(r"(?:^|[\s?&;])(?:password|passwd|pwd|sslpassword)\s*=", target, re.I):
        raise ValueError("the target holds a password; give it as an option")


def lookup(spark: SparkSession, names: list[str]) -> dict[str, str]:
    """Each name's state: found, missing or unreadable."""
    out = {}
    for name in names:
        try:
            spark.table(name).schema  # noqa: B018
            out[name] = "found"
        except AnalysisException as e:
            out[name] = "missing" if "NOT_FOUND" in str(e) else "unreadable"
    return out


def columns(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema.fields]
