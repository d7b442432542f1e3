"""A progress table that is compacted: a snapshot and the saves since.

Saves go to the folder of the version they follow. Compacting writes the newest row of every run and channel
as a new snapshot and then, as one file, the version that names it; readers take the newest version, its
snapshot and the saves that follow it, so a compaction that breaks off changes nothing and old saves
are no longer listed or read. One writer at a time; folders of earlier versions stay until they are deleted by hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators import progress as operators
from palaver.schema import EXPANDED, PROGRESS

VERSIONS = "version bigint, snapshot string"
_TABLES = {"progress": PROGRESS, "expanded": EXPANDED}


def append(path: str, progress: DataFrame, expanded: DataFrame | None = None) -> None:
    """Add a save: rows of ``PROGRESS`` and, if any, of ``EXPANDED``. Each of the two becomes visible as a whole."""
    version, _ = _newest(progress.sparkSession, path)
    for name, rows in (("expanded", expanded), ("progress", progress)):
        if rows is not None:
            rows.select(*_columns(progress.sparkSession, name)).write.mode("append").parquet(f"{path}/saves/{name}/after={version}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest ``PROGRESS`` row per run and channel."""
    return operators.latest(_stored(spark, path, "progress"))


def read_expanded(spark: SparkSession, path: str) -> DataFrame:
    """``EXPANDED`` rows, each once."""
    return _stored(spark, path, "expanded").distinct()


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row ``n``: how many progress rows a reader has to look at."""
    return _stored(spark, path, "progress").agg(F.count(F.lit(1)).alias("n"))


def compact(spark: SparkSession, path: str) -> None:
    """Put the saves since the last snapshot and that snapshot into a new one."""
    version, _ = _newest(spark, path)
    _switch(spark, path, version, _snapshot(spark, path))


def _snapshot(spark: SparkSession, path: str) -> str:
    name = uuid.uuid4().hex
    read(spark, path).write.parquet(f"{path}/snapshots/{name}/progress")
    read_expanded(spark, path).write.parquet(f"{path}/snapshots/{name}/expanded")
    return name


def _switch(spark: SparkSession, path: str, version: int, snapshot: str) -> None:
    spark.createDataFrame([(version + 1, snapshot)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def _newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    spark.createDataFrame([], VERSIONS).write.mode("append").parquet(f"{path}/versions")  # makes the folder
    newest = spark.read.schema(VERSIONS).parquet(f"{path}/versions").agg(F.max(F.struct("version", "snapshot")).alias("v")).first().v
    return (newest.version, newest.snapshot) if newest else (0, None)


def _columns(spark: SparkSession, name: str) -> list[str]:
    return spark.createDataFrame([], _TABLES[name]).columns


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    version, snapshot = _newest(spark, path)
    saves = f"{path}/saves/{name}/after={version}"
    spark.createDataFrame([], _TABLES[name]).write.mode("append").parquet(saves)  # makes the folder
    folders = [saves, *([f"{path}/snapshots/{snapshot}/{name}"] if snapshot else [])]
    return spark.read.schema(_TABLES[name]).parquet(*folders)
