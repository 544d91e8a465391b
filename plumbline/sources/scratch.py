"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one gets one of this machine; on a cluster,
    whose machines share none, that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, run once and held in the shared folder, so that later reads see one execution."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unsettle(df: DataFrame) -> None:
    """Deletes the files of a settled frame, if it is one."""
    rdd = df._jdf.queryExecution().toRdd()
    for one in [rdd, *(rdd.dependencies().apply(i).rdd() for i in range(rdd.dependencies().size()))]:
        held = one.getCheckpointFile()
        if held.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(held.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file on any file system of Spark's."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
