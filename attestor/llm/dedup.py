"""Exact duplicates (operator 3): 128-bit content hash, byte comparison inside groups, one stable survivor.

DataFrame functions only. Equal texts are texts that are identical after deleting white space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import ROW, SPACE_RUN, broadcast_small, cut, read, whole, with_row

ORDER = ["long_first", "no_id", "id", "row"]


def normalised(text):
    return F.regexp_replace(whole(text), SPACE_RUN, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.md5) -> DataFrame:
    """One row per row of ``docs``: ``_row``, the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``docs`` carries ``_row`` (``common.with_row``); other columns, whatever their names, are ignored. Rows are grouped by a
    128-bit hash of the normalised text. Inside groups of two or more, every text is compared with the survivor's bytes;
    texts that differ (collisions) form groups of their own, keyed by their bytes. The row with most code points stays, then
    the one with the smallest id (null last), then the first row, so of rows repeated with one id exactly one stays. A null
    text is empty, and empty texts are equal to each other. An empty table gives no rows.

    Only hashes and lengths of all rows are shuffled; texts move for members of groups of two or more. A hot group is one
    key on the large side of joins whose other side has one row per group, which adaptive execution splits.
    """
    text = F.col(text_col)
    rows = docs.select(ROW, F.col(id_col).alias("id"), normalised(text_col).alias("norm"), F.char_length(whole(text)).cast("long").alias("n"))
    keys = cut(rows.select(ROW, "id", F.unhex(hash_of("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"), "n"))
    rank = F.struct((-F.col("n")).alias("long_first"), F.col("id").isNull().alias("no_id"), "id", F.col(ROW).alias("row"))
    leaders = keys.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min(rank).alias("keep")).where("size > 1").select("h", F.col("keep.row").alias("leader"))
    leaders = broadcast_small(leaders)
    members = rows.select(ROW, F.unhex(hash_of("norm")).alias("h"), "norm").join(leaders, "h")
    texts = members.where(F.col(ROW) == F.col("leader")).select("h", F.col("norm").alias("leader_norm"))
    # The hash join keeps the group's members on the streamed side, so a hot group can be split.
    differing = members.where(F.col(ROW) != F.col("leader")).join(texts, "h").where("norm <> leader_norm")
    apart = cut(differing.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.lit(True).alias("apart")).distinct())
    classed = keys.join(apart, ["h", "sha"], "left").withColumn("part", F.when(F.col("apart"), F.col("sha")).otherwise(F.lit(b""))).drop("apart")
    # Stored, so that the join below has a plain exchange on both sides and a hot group's rows can be split over tasks.
    groups = cut(classed.groupBy("h", "part").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("keep")))
    return classed.join(groups, ["h", "part"]).select(
        ROW, F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col(ROW) == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def op3_exact_dedup(spark, d):
    return exact_groups(with_row(read(spark, d, "documents"))).drop(ROW)


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {"op3_exact_dedup": r"""
with n as (select doc_id, length(coalesce(text, '')) as cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select norm, count(*) as group_size, first(doc_id order by cp desc, doc_id) as keep_id from n group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from n join g using (norm)
"""}
