"""Indexes kept as tables on shared storage, built once per session and state of their input files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple, str] = {}


@lru_cache(maxsize=None)
def _local_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="attestor-index-")


def store_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the warehouse; a temporary folder only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master == "local" or context.master.startswith("local["):
        return _local_folder(context.applicationId)
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def file_state(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of every file of a table, as the file system tells them."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    status = [system.getFileStatus(place)]
    found = status if status[0].isFile() else system.listStatus(place)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], object]) -> str:
    """Folder that ``build`` has filled for these inputs as they are now; another state of a file gets another folder."""
    key = (spark.sparkContext.applicationId, name, tuple(file_state(spark, p) for p in inputs))
    if key not in _PATHS:
        path = f"{store_root(spark)}/index-{name}-{uuid.uuid4().hex}"
        build(path)
        _PATHS[key] = path
    return _PATHS[key]


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to shared storage and read again: computed once, with a short plan that a lost executor does not undo."""
    path = f"{store_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, path: str, prefix: str = "commit=") -> list[int]:
    """Numbers of the tables ``<prefix><number>`` below ``path`` that were written to their end, ascending."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []
    return sorted(int(p.getName()[len(prefix):]) for p in names if p.getName().startswith(prefix) and files.exists(hadoop.Path(p, "_SUCCESS")))


def commit_tables(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None, check: Callable[[Callable[[str], DataFrame]], bool] | None = None) -> int | None:
    """Writes a set of tables and then one pointer row that makes all of them visible at once; returns the commit's number.

    Tables go to a folder of their own. Until the pointer is written to its end, readers see the set before; what a failed writer has left is never
    read. ``check`` sees the written tables and may refuse them: then there is no pointer, and None is returned.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"sets/{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df.write.partitionBy(*partition_by[name]) if partition_by and partition_by.get(name) else df.write
        writer.parquet(f"{path}/{folder}/{name}")
    if check is not None and not check(lambda name: spark.read.parquet(f"{path}/{folder}/{name}")):
        return None
    number = max(finished(spark, f"{path}/pointer"), default=-1) + 1
    spark.createDataFrame([(folder, sorted(tables))], "folder string, tables array<string>").coalesce(1).write.mode("errorifexists").parquet(f"{path}/pointer/commit={number}")
    return number


def read_committed(spark: SparkSession, path: str, name: str, commit: int | None = None) -> DataFrame:
    """A table of the last committed set, or of the set ``commit``."""
    numbers = finished(spark, f"{path}/pointer")
    if not numbers or (commit is not None and commit not in numbers):
        raise ValueError("no_committed_set")
    pointer = spark.read.parquet(f"{path}/pointer/commit={numbers[-1] if commit is None else commit}").first()
    return spark.read.parquet(f"{path}/{pointer['folder']}/{name}")
