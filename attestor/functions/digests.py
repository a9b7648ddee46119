"""Deterministic ids and order-free digests as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u0001"


def uuid5(namespace: Column, name: Column) -> Column:
    """Name-based UUID version 5, byte-equal to RFC 4122."""
    raw = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"))), F.encode(name, "UTF-8")))
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab89ab89ab89ab"]),
        (F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") + 1),
    )
    return F.concat(
        F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-5"), F.substring(raw, 14, 3),
        F.lit("-"), variant, F.substring(raw, 18, 3), F.lit("-"), F.substring(raw, 21, 12),
    )


def canonical(*columns) -> Column:
    """One string per row with a separator that text cannot contain; nulls stay visible."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("\u0002")).cast("string")
                                    for c in columns])


def row_digest(*columns) -> Column:
    return F.sha2(canonical(*columns), 256)


def _piece(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")


def multiset_digest(row_hash: Column) -> Column:
    """Aggregate: order-free digest of a group of row hashes.

    Adding hash pieces commutes, so every map task sums its own rows first and a
    version that holds most of the table still ends in one small row per task.
    """
    return F.sha2(
        F.concat_ws(
            ":", F.count(row_hash).cast("string"),
            *[F.sum(_piece(row_hash, start)).cast("string") for start in (1, 16, 31, 46)],
        ),
        256,
    )
