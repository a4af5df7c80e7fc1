"""Where streams, sinks and written steps keep their files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one where none is set, if all tasks run on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return _own[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows depends on files that outlive any executor, and reads
    them as often as it likes.  The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palimpsest-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
