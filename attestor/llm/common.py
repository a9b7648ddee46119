"""What the operators of this subpackage share: table access, row identity, bounded broadcasts and shared-storage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of every text contract: the characters [\x20\x09-\x0D].
SPACE_RUN = "[ \\t-\\r]+"
# A side of at most this many narrow rows (an id or a hash each) may be broadcast; it is counted before.
BROADCAST_ROWS = 1_000_000
ROW = "_row"
FILE_ROW_BITS = 40  # of a row's number, for its place in its file


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``; a temporary one only on a local master (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None:
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="attestor-llm-")
        context.setCheckpointDir(configured)
    return configured


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder on shared storage, never used before."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint on shared storage: the rows are computed once and survive the loss of executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to a new folder on shared storage and read again: less disk than ``cut`` for many narrow rows."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when a bounded count proves that it is small; else the join shuffles both sides."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def whole(column: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters outside ``[\\x20\\x09-\\x0D]``."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def scans_files(df: DataFrame) -> bool:
    """Whether ``df`` is one scan of files with nothing but projections and filters above it, so that each of its rows is one row of a file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "HadoopFsRelation" in plan.relation().getClass().getName()


def named(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with more underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def with_row(df: DataFrame) -> DataFrame:
    """Adds ``_row``, which tells repeated rows apart and is the same in every pass, however the scan is split.

    For a scan of files it is made of the number of the file, in order of paths, and the row's place in it. Any other table is stored
    once with its numbers, since a second run may deal its rows out differently. A column of the table that is itself called
    ``_row`` (``__row``, ...) gets one more underscore until ``without_row`` gives its name back; every other name may occur.
    """
    df = df.select(*[named(df, c).alias("_" + c if re.fullmatch(f"_*{ROW}", c.lower()) else c) for c in df.columns])
    if not scans_files(df):
        return cut(df.withColumn(ROW, F.monotonically_increasing_id()))
    # The files are counted once and stored; from each, only its path is read.
    path, index, file = (free_name(c, df) for c in ("_path", "_index", "_file"))
    hidden = df.metadataColumn("_metadata")
    paths = df.select(hidden["file_path"].alias(path)).distinct()
    files = cut(paths.select(path, (F.row_number().over(Window.orderBy(path)) - 1).cast("long").alias(file)))
    placed = df.select("*", hidden["file_path"].alias(path), hidden["row_index"].alias(index))
    joined = placed.join(F.broadcast(files), path)
    return joined.select(*[named(joined, c) for c in df.columns], (F.shiftleft(file, FILE_ROW_BITS) + F.col(index)).alias(ROW))


def without_row(tagged: DataFrame) -> DataFrame:
    """``tagged`` without the tag, its own columns under their own names again."""
    own = [c for c in tagged.columns if c != ROW]
    return tagged.select(*[named(tagged, c).alias(c[1:] if re.fullmatch(f"_+{ROW}", c.lower()) else c) for c in own])


def only_rows(tagged: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``tagged`` whose ``_row`` is in ``kept``, without the tag."""
    return without_row(tagged.join(broadcast_small(cut(kept.select(ROW))), ROW, "left_semi"))
