"""Session settings and the one size check every broadcast in this library goes through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side with at most this many rows may be sent to every executor.
BROADCAST_ROWS = 500_000


def build_session(app_name: str = "attestor", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC timestamps."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key: str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than ``max_rows + 1``."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_bounded(df: DataFrame, bound: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when ``bound`` proves its size.

    ``bound`` must have at least as many rows as ``df``. It is normally the small
    request-side table ``df`` derives from, so the check costs one tiny job. Above
    the limit ``df`` is returned unhinted and the join shuffles both sides, where
    adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if fits_broadcast(bound, max_rows) else df

