"""Scalar functions on names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_token(value: Column) -> Column:
    """value as text with every character but letters, digits and = - _ . made an underscore, for use in ids and paths."""
    return F.regexp_replace(value.cast("string"), r"[^\p{L}\p{N}=_.-]", "_")
