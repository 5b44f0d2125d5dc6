"""Shared storage of intermediate results.

Lineage is cut by writing Parquet into the folder that the cluster names in
``spark.checkpoint.dir``, which driver and executors share. Only a session that runs
in one process (a local master) may leave that unset; it uses a folder under ``/tmp``.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where ``spark.checkpoint.dir`` is unset.
LOCAL_FOLDER = "file:///tmp/checkpoints/tarnflow"

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can read."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_FOLDER).rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_folder(spark)}/tarnflow-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the copy."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` returned, once nothing reads it any more."""
    path = getattr(df, "_written_to", None)
    for entry in [x for x in _written if x[1] == path]:
        _written.remove(entry)
        _delete(*entry)


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _target(spark, path)
    return system.exists(target)


def numbered_folders(spark: SparkSession, path: str) -> list[int]:
    """The names of the folders in a folder that are numbers, in order."""
    system, target = _target(spark, path)
    names = [x.getPath().getName() for x in system.listStatus(target)] if system.exists(target) else []
    return sorted(int(name) for name in names if name.isdigit())


def _delete(spark: SparkSession, path: str) -> None:
    system, target = _target(spark, path)
    system.delete(target, True)


def release() -> None:
    """Delete the tables that this process has written."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session has ended; its folder goes with it
            continue


atexit.register(release)
