"""Streams of ingest requests, publications, tombstones and job states (K1 to K4).

Each stream has a batch function that gives the same answer on a finished set of events; the stream applies it
micro-batch by micro-batch and writes its state as versioned tables, because Parquet has no in-place merge.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from attestor.sources.stored import cut, finished

# Retry and lease rules.
MAX_BACKOFF_SECONDS, MAX_ATTEMPTS = 60, 3

JOB_SCHEMA = "job_id string, status string, attempts int, next_attempt_at timestamp, seq long"


def stream_ingest(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "1 day"):
    """K1: every idempotency key once; ``sink`` runs the batch operators on each micro-batch.

    ``events(principal_id, kb_id, idempotency_key, ts, ...)``. The watermark bounds the keys remembered.
    """
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["principal_id", "kb_id", "idempotency_key"])
    return once.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publication_state(events: DataFrame) -> DataFrame:
    """K2: the visible pointer per document: its last publish, or none after a delete. An older event never wins.

    ``events(document_id, seq, kind, version_id)``.
    """
    return events.groupBy("document_id").agg(F.max_by(F.struct("kind", "version_id"), "seq").alias("last"), F.max("seq").alias("seq")).select(
        "document_id", F.col("last.kind").alias("kind"), F.when(F.col("last.kind") != "delete", F.col("last.version_id")).alias("active_version_id"), "seq")


PUBLICATION_SCHEMA = "document_id string, kind string, active_version_id string, seq long"
PUBLICATION_BUCKETS = 256


def _bucket_epochs(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Per bucket, the epoch that holds its state: the last finished manifest, at most one row a bucket."""
    done = [e for e in finished(spark, f"{path}/manifest", "epoch=") if before is None or e < before]
    return {r["bucket"]: r["epoch"] for r in spark.read.parquet(f"{path}/manifest/epoch={done[-1]}").collect()} if done else {}


def read_publications(spark: SparkSession, path: str, buckets: dict[int, int] | None = None) -> DataFrame:
    """The state that the last finished micro-batch left; with ``buckets`` (bucket to epoch) only theirs."""
    held = _bucket_epochs(spark, path) if buckets is None else buckets
    folders = [f"{path}/data/epoch={epoch}/bucket={bucket}" for bucket, epoch in sorted(held.items())]
    return spark.read.schema(PUBLICATION_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], PUBLICATION_SCHEMA)


def merge_publications(batch: DataFrame, epoch: int, path: str, buckets: int = PUBLICATION_BUCKETS) -> None:
    """Merges a micro-batch into the state at ``path``: only buckets with an event are read and written again.

    The buckets' new files are written first and named by the epoch's manifest last. Until the manifest is there, readers see the old
    state, and an epoch that runs again starts from the same state and writes the same files.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    events = cut(batch.select("document_id", "seq", "kind", "version_id"))
    touched = [r["bucket"] for r in events.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
    held = _bucket_epochs(spark, path, epoch)
    old = read_publications(spark, path, {b: held[b] for b in touched if b in held})
    merged = publication_state(old.select("document_id", "seq", "kind", F.col("active_version_id").alias("version_id")).unionByName(events))
    if touched:
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
    rows = sorted((held | dict.fromkeys(touched, epoch)).items())
    spark.createDataFrame(rows, "bucket int, epoch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch}")


def stream_publications(events: DataFrame, state_path: str, checkpoint: str, buckets: int = PUBLICATION_BUCKETS):
    """K2 as a stream: state and new events are merged by sequence number, bucket by bucket; ``read_publications`` gives the state."""
    return events.writeStream.foreachBatch(lambda batch, epoch: merge_publications(batch, epoch, state_path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tombstones(events: DataFrame, versions: DataFrame) -> DataFrame:
    """K3: rows to remove from a projection. A delete removes the document; a switch removes only versions that are
    superseded now, so an old event cannot remove a newer or a ready version.

    ``events(document_id, kind)``; ``versions(document_id, version_id, status)``.
    """
    deleted = events.where("kind = 'document_deleted'").select("document_id", F.lit(None).cast(versions.schema["version_id"].dataType).alias("version_id")).distinct()
    switched = events.where("kind = 'publication_switched'").select("document_id").distinct()
    retired = versions.where("status = 'superseded'").join(switched, "document_id", "left_semi").select("document_id", "version_id")
    return deleted.unionByName(retired)


def stream_tombstones(events: DataFrame, versions: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str):
    """K3 as a stream: ``versions`` is read fresh per micro-batch and ``apply`` removes the rows."""
    def run(batch: DataFrame, epoch: int) -> None:
        apply(tombstones(batch, versions()), epoch)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_state(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """K4 batch twin: status, attempts and next attempt per job from its events ``job_id, seq, ts, kind``.

    ``kind``: queued, claimed, succeeded or error. An error waits min(60, 2^attempts) seconds and queues again until the
    attempts run out; success is final, and what follows it is ignored, as in the stream. Leases expire in the stream only: they
    depend on the time of processing.
    """
    first = events.where("kind = 'succeeded'").groupBy("job_id").agg(F.min("seq").alias("final"))
    events = events.join(first, "job_id", "left").where(F.col("final").isNull() | (F.col("seq") <= F.col("final")))
    rows = events.groupBy("job_id").agg(
        F.count_if(F.col("kind") == "claimed").alias("attempts"), F.max_by(F.struct("kind", "ts"), "seq").alias("last"),
        F.bool_or(F.col("kind") == "succeeded").alias("done"), F.max("seq").alias("seq"))
    wait = F.least(F.lit(MAX_BACKOFF_SECONDS), F.pow(F.lit(2), F.least(F.col("attempts"), F.lit(10))).cast("int"))
    spent = F.col("attempts") >= max_attempts
    status = F.when(F.col("done"), "succeeded").when(F.col("last.kind") == "claimed", "running").when(
        F.col("last.kind") == "error", F.when(spent, "failed").otherwise("queued")).otherwise("queued")
    retry = F.when(~F.col("done") & (F.col("last.kind") == "error") & ~spent, F.col("last.ts") + F.make_dt_interval(secs=wait.cast("decimal(18,6)")))
    return rows.select("job_id", status.alias("status"), F.col("attempts").cast("int").alias("attempts"), retry.alias("next_attempt_at"), "seq")


class JobStates(StatefulProcessor):
    """K4: one small state row per job; a lease timer puts a silent running job back in the queue."""

    def __init__(self, lease_seconds: int, max_attempts: int = MAX_ATTEMPTS):
        self.lease_seconds, self.max_attempts = lease_seconds, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempts int, seq long, lease long")

    def _row(self, key, status, attempts, seq, retry_at=None):
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts], "next_attempt_at": pd.to_datetime([retry_at]), "seq": [seq]})

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        status, attempts, seq, lease = self.state.get() if self.state.exists() else ("queued", 0, -1, None)
        retry_at = None
        frame = pd.concat(list(rows)).sort_values("seq")
        for event in frame.itertuples():
            if event.seq <= seq or status == "succeeded":
                continue
            seq, retry_at = event.seq, None
            if lease is not None:  # a lease ends with the claim that took it
                self.handle.deleteTimer(lease)
                lease = None
            if event.kind == "claimed":
                status, attempts = "running", attempts + 1
                lease = int(timer_values.getCurrentProcessingTimeInMs() + 1000 * self.lease_seconds)
                self.handle.registerTimer(lease)
            elif event.kind == "error":
                status = "failed" if attempts >= self.max_attempts else "queued"
                if status == "queued":
                    retry_at = event.ts + pd.Timedelta(seconds=min(MAX_BACKOFF_SECONDS, 2 ** attempts))
            elif event.kind == "succeeded":
                status = "succeeded"
            else:
                status = "queued"
        self.state.update((status, int(attempts), int(seq), lease))
        yield self._row(key, status, attempts, seq, retry_at)

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            status, attempts, seq, lease = self.state.get()
            if status == "running" and lease == expired_timer_info.getExpiryTimeInMs():
                status = "failed" if attempts >= self.max_attempts else "queued"
                self.state.update((status, attempts, seq, None))
                yield self._row(key, status, attempts, seq)

    def close(self) -> None:
        pass


def stream_job_state(events: DataFrame, lease_seconds: int = 300, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """K4 as a stream: keyed state with a timer; needs the RocksDB state store provider."""
    return events.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobStates(lease_seconds, max_attempts), outputStructType=JOB_SCHEMA, outputMode="Update", timeMode="ProcessingTime")
