"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``stored`` has written and ``clear`` has not removed.
_WRITTEN: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share. Where that is unset, a session on
    one machine gets a temporary folder; on a cluster it is an error, since its machines share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/veilspark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: what follows plans and computes it no more, and a lost
    executor costs only its own tasks. ``clear`` removes the folders once what was made of them has been written."""
    spark, path = df.sparkSession, work_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The folders of ``stored`` that are still there."""
    return list(_WRITTEN)


def clear(spark: SparkSession, keep: DataFrame | None = None, leave: list[str] | tuple = ()) -> None:
    """Removes the folders of ``stored``, but for those that ``keep`` reads and those of ``leave``."""
    held = keep.inputFiles() if keep is not None else []
    for path in [p for p in _WRITTEN if p not in leave and not any(p.rpartition("/")[2] in f for f in held)]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _WRITTEN.remove(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for long expressions over a small table. A table of many files
    stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
