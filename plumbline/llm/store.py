"""Scratch tables in the folder that driver and executors share, and small helpers for columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session without one gets a folder of this machine; on a
    cluster, whose machines share none, that would lose rows, so that it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by drop_scratch."""
    path = f"{scratch_root(spark).rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """For drop_scratch: what is made from here on."""
    return len(_made)


def drop_scratch(spark: SparkSession | None = None, since: int = 0, until: int | None = None) -> None:
    """Deletes the scratch tables made so far, or from one mark up to another; frames that still read them can't be used
    afterwards."""
    for own, path in _made[since:until]:
        if spark is None or own is spark:
            try:
                jvm = own.sparkContext._jvm
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(own.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            except Exception:  # the session may be gone at exit  # noqa: BLE001
                pass
            _made.remove((own, path))


atexit.register(drop_scratch)


def free_names(wanted: list[str], *frames: DataFrame) -> list[str]:
    """The wanted names, each behind as many underscores as it takes to be no column's."""
    taken, out = {c.lower() for df in frames for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_training_folds(doc_id):
    """Whether labels of this document may be learned from: crc32 of the id as text, mod 5, isn't 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0
