"""Files of a table, through Hadoop's file systems: a path may be in a store that only Spark reaches."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A temporary one serves only in local mode, where all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="zoneframe-")


def inside(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def _held(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _held(spark, path)
    return bool(system.exists(place))


def delete(spark: SparkSession, path: str) -> None:
    system, place = _held(spark, path)
    system.delete(place, True)


def gather(spark: SparkSession, folders: Sequence[str], path: str) -> None:
    """Moves the one data file of each folder into a new table, named in order; FileExistsError if the table is there."""
    if exists(spark, path):
        raise FileExistsError(path)
    system, table = _held(spark, path)
    system.mkdirs(table)
    for k, folder in enumerate(folders):
        for status in system.listStatus(_held(spark, folder)[1]):
            if status.getPath().getName().startswith("part-"):
                system.rename(status.getPath(), _held(spark, inside(path, f"part-{k:06d}.parquet"))[1])
    system.create(_held(spark, inside(path, "_SUCCESS"))[1]).close()
