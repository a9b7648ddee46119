"""Dotted version numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_VERSION = r"^\d+(?:\.\d+)*$"


def version_parts(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda p: p.cast("long"))


def version_at_least(left: Column, right: Column) -> Column:
    """Numeric comparison with zero padding, so 2.10 is newer than 2.1 and 2.1 equals 2.1.0."""
    width = F.greatest(F.size(F.split(left, r"\.")), F.size(F.split(right, r"\.")))

    def padded(text: Column) -> Column:
        parts = version_parts(text)
        return F.concat(parts, F.array_repeat(F.lit(0).cast("long"), width - F.size(parts)))

    return padded(left) >= padded(right)
