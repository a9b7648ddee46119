"""Originals, strict JSON lines, recorded rankings, results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LINE_BYTES = 512 * 1024  # fixed value


def read_originals(spark: SparkSession, path: str) -> DataFrame:
    """A1: ``uri, sha256, content, media_type``; the same bytes appear once, under their smallest path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = raw.select(F.col("path").alias("uri"), F.sha2("content", 256).alias("sha256"), "content")
    first = rows.groupBy("sha256").agg(F.min("uri").alias("uri"))
    media = F.when(F.col("uri").rlike(r"(?i)\.(md|markdown)$"), "text/markdown").when(F.col("uri").rlike(r"(?i)\.txt$"), "text/plain").otherwise("application/octet-stream")
    return rows.join(first, ["sha256", "uri"], "left_semi").withColumn("media_type", media)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """A2: one record per line; blank lines pass. A bad line, an unknown field or a line over 512 KiB stops the read and
    names only its file. Unknown fields are found by comparing the line's keys with the schema."""
    lines = spark.read.text(path).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).where(F.length(F.trim("value")) > 0)
    parsed = F.from_json("value", T.StructType(schema.fields + [T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    unknown = F.size(F.array_except(F.coalesce(F.json_object_keys("value"), F.array(F.lit("_bad"))), F.array(*[F.lit(f.name) for f in schema.fields]))) > 0
    wrong = (F.octet_length("value") > MAX_LINE_BYTES) | F.col("r._bad").isNotNull() | F.col("r").isNull() | unknown
    rows = lines.withColumn("r", parsed).withColumn("ok", F.when(wrong, F.raise_error(F.concat(F.lit("invalid_"), "file"))).otherwise(F.lit(True))).where("ok")
    out = rows.select("r.*").drop("_bad")
    if limit is not None and out.limit(limit + 1).count() > limit:
        raise ValueError("input_row_limit_exceeded")
    return out


def search_key(method: str = "method"):
    """Order-free key of a recorded call: method, input, knowledge bases, filters."""
    return F.sha2(F.concat_ws("\u0001", method, F.coalesce("query", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")),
                              F.array_join(F.array_sort("kb_ids"), ","), F.coalesce(F.to_json("filters"), F.lit(""))), 256)


def recorded_candidates(recordings: DataFrame, requests: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(ranking rows, missing requests)``. A missing or too short recording is an error row, never a fallback.

    ``recordings(method, query, vector, kb_ids, filters, hits array<struct<id, score>>, captured_limit)``.
    """
    saved = recordings.select(search_key().alias("key"), "hits", "captured_limit")
    asked = requests.select("request_id", search_key().alias("key"))
    found = asked.join(saved.where(F.col("captured_limit") >= limit), "key")
    rows = found.select("request_id", F.posexplode(F.slice("hits", 1, limit)).alias("i", "h")).select(
        "request_id", F.col("h.id").alias("chunk_id"), (F.col("i") + 1).alias("rank"), F.col("h.score").alias("score"))
    missing = asked.join(found.select("request_id"), "request_id", "left_anti").select("request_id", F.lit("missing_or_insufficient_recording").alias("error_code"))
    return rows, missing


def write_result(df: DataFrame, path: str, overwrite: bool = False, file_format: str = "parquet") -> None:
    """A10: publish whole or not at all; an existing target is refused unless asked."""
    df.write.mode("overwrite" if overwrite else "errorifexists").format(file_format).save(path)


def write_report(rows: DataFrame, summary: DataFrame, path: str, bodies: tuple[str, ...] = ("source_text", "context", "search_text")) -> None:
    """Per-request JSON lines without bodies, and a one-row summary."""
    rows.drop(*bodies).write.mode("errorifexists").json(f"{path}/requests")
    summary.coalesce(1).write.mode("errorifexists").json(f"{path}/summary")
