"""Places where a job may cut its lineage: written tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder made once, on a local master only:
    on a cluster the executors would not see each other's files, so there it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.repeatloom.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: on {master} it has to name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="repeatloom-")
        spark.conf.set("spark.repeatloom.dir", known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: what follows survives lost executors
    and does not compute df again. The schema is kept as it was, also for no rows."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes one written table, if it is still there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def drop_written(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that operators of this process have written, from the given number on: once the results
    are stored, as a DataFrame that an operator gave reads them."""
    for path in _WRITTEN[since:]:
        drop(spark, path)


def n_written() -> int:
    return len(_WRITTEN)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores: a small file is one task otherwise. Larger inputs stay as they are read."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
