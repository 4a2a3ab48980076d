"""Tables written between stages, in the shared folder the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without one, a local folder serves a local master only, until Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="kinfold-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


_local: list[str] = []
_tracked: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/kinfold/{name}-{uuid.uuid4().hex}"
    for paths in _tracked:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Removes the scratch tables made within it at its end; results must be written by then."""
    paths: list[str] = []
    _tracked.append(paths)
    try:
        yield paths
    finally:
        _tracked.remove(paths)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """Write a stage result once and read it back: short lineage, known size, no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Number of tasks for a stage whose work per row is far larger than its bytes."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(shuffle, spark.sparkContext.defaultParallelism)
