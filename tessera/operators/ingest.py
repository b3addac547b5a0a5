"""Batch import in a field window, with a journal that can take it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.writes import first, merge_write, met
from tessera.sources.catalog import Table

DEFAULT_WINDOW = 64
BEFORE = "struct<fields:map<string,struct<type:string,s:string,i:bigint,f:double,b:boolean>>,version_id:string,written_at:timestamp_ntz>"
JOURNAL = f"journal_seq bigint, batch_id string, segment int, entity string, before {BEFORE}"


def file_fields(rows: DataFrame) -> DataFrame:
    """(field): names used by any row."""
    return rows.select(F.explode(F.map_keys("fields")).alias("field")).distinct()


def field_window(rows: DataFrame, table: Table) -> list[str]:
    """Names that both rows and the table's schema have, in order; at most the schema's."""
    return sorted(r.field for r in file_fields(rows).where(F.col("field").isin(table.field_names())).collect())


def with_segments(rows: DataFrame, window_size: int = DEFAULT_WINDOW) -> DataFrame:
    size = window_size if window_size > 0 else DEFAULT_WINDOW
    return rows.withColumn("segment", F.floor(F.col("row_no") / size).cast("int"))


def segments(rows: DataFrame, window_size: int = DEFAULT_WINDOW) -> DataFrame:
    """(segment, rows) of an import of rows numbered from 0."""
    return with_segments(rows, window_size).groupBy("segment").agg(F.count("*").alias("rows"))


def journal_of(entries: DataFrame, rows: DataFrame, batch_id: str, base_seq: int = 0, window_size: int = DEFAULT_WINDOW) -> DataFrame:
    """Before-states of an import: one row for each entity, at its first row in the batch; null for an entity that is not there."""
    touched = first(with_segments(rows, window_size), "row_no", "segment")
    old = entries.select("entity", F.struct("fields", "version_id", "written_at").alias("before"))
    return touched.join(old, "entity", "left").select(
        (F.col("row_no") + base_seq).cast("bigint").alias("journal_seq"), F.lit(batch_id).alias("batch_id"), "segment", "entity", "before"
    )


def import_batch(entries: DataFrame, rows: DataFrame, window: list[str], version_id: str, at) -> DataFrame:
    """Merge rows (row_no, entity, fields) into ``entries`` within the window."""
    log = rows.select(
        F.col("row_no").alias("seq"), "entity", "fields", F.lit(version_id).alias("version_id"), F.lit(at).cast("timestamp_ntz").alias("written_at")
    )
    return merge_write(entries, log, window)


def first_before(journal: DataFrame, batch_id: str) -> DataFrame:
    """The state of each of a batch's entities before its first change."""
    own = journal.where(F.col("batch_id") == batch_id)
    # A null before-state has to win too, so it travels inside a struct.
    return first(own.select("entity", "journal_seq", F.struct("before").alias("_b")), "_b", by="journal_seq").select("entity", "_b.before")


def last_before(journal: DataFrame) -> DataFrame:
    """The latest journalled before-state of each entity, over all batches."""
    held = journal.select("entity", "journal_seq", F.struct("before").alias("_b"))
    return held.groupBy("entity").agg(F.max_by("_b", "journal_seq").alias("_b")).select("entity", "_b.before")


def rollback(entries: DataFrame, journal: DataFrame, batch_id: str) -> DataFrame:
    """Every entity of the batch as before it, version and time included; those that were not there go."""
    both = met(entries, first_before(journal, batch_id).select("entity", F.lit(True).alias("in_batch"), "before"))
    state = F.when(F.col("in_batch"), F.col("before")).otherwise(F.col("old"))
    return both.select("entity", state.alias("_s")).where("_s IS NOT NULL").select("entity", "_s.*")


def ops_for(journal: DataFrame, batch_id: str, segment: int | None = None) -> DataFrame:
    own = journal.where(F.col("batch_id") == batch_id)
    return own if segment is None else own.where(F.col("segment") == segment)


def cleared(journal: DataFrame, batch_id: str) -> DataFrame:
    return journal.where(F.col("batch_id") != batch_id)
