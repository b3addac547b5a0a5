"""Times without a zone, as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(t: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))
