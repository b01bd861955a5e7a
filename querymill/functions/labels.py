"""Category labels that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_key(label: Column) -> Column:
    """Letter case, outer spaces, and the separator between words (space, hyphen, underscore) aside; blank gives null."""
    key = F.regexp_replace(F.lower(F.regexp_replace(label, r"^[\s_\-]+|[\s_\-]+$", "")), r"[\s_\-]+", "_")
    return F.when(key != "", key)
