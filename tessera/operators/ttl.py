"""Expiry by age."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TTL = timedelta(hours=24)


def _bound(now: datetime, ttl: timedelta) -> Column:
    return F.lit(now - (ttl if ttl > timedelta(0) else DEFAULT_TTL)).cast("timestamp_ntz")


def is_expired(age: timedelta, ttl: timedelta) -> bool:
    """Strictly older than the limit."""
    return age > (ttl if ttl > timedelta(0) else DEFAULT_TTL)


def expired(entries: DataFrame, now: datetime, ttl: timedelta = DEFAULT_TTL) -> DataFrame:
    return entries.where(F.col("written_at") < _bound(now, ttl))


def survivors(entries: DataFrame, now: datetime, ttl: timedelta = DEFAULT_TTL) -> DataFrame:
    """Entries that are not strictly older than ``ttl``; those without a time stay."""
    return entries.where(F.col("written_at").isNull() | (F.col("written_at") >= _bound(now, ttl)))
