"""Reads through a version's layout; an absent entity is an empty snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import slot
from tessera.functions.values import no_fields, only
from tessera.operators.versions import Version


def layout(version: Version | None) -> list[str] | None:
    """Fields that a version shows; None for no filter."""
    return version.fields if version is not None and version.fields else None


def projected(entries: DataFrame, names: list[str] | None) -> DataFrame:
    return entries if names is None else entries.withColumn("fields", only(F.col("fields"), names))


def read(keys: DataFrame, entries: DataFrame, version: Version | None, requested: str = "") -> DataFrame:
    """(entity, version_id, fields, written_at) of each row of ``keys``.

    Found entities report their stored version, absent ones the requested one
    with no fields.
    """
    shown = projected(entries.select("entity", "fields", "version_id", "written_at"), layout(version))
    return keys.select("entity").join(shown, "entity", "left").select(
        "entity", F.coalesce("version_id", F.lit(requested)).alias("version_id"), F.coalesce("fields", no_fields()).alias("fields"), "written_at"
    )


def entry_for(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries as stored, without a layout; null columns for absent ones."""
    return keys.select("entity").join(entries, "entity", "left")


def written_at(keys: DataFrame, entries: DataFrame) -> DataFrame:
    return keys.select("entity").join(entries.select("entity", "written_at"), "entity", "left")


def keys_of(entries: DataFrame, shard: int, shards: int) -> DataFrame:
    """Entities of a shard; none for a shard out of range."""
    if not 0 <= shard < shards:
        return entries.where("false").select("entity")
    return entries.where(slot(F.col("entity"), shards) == shard).select("entity")
