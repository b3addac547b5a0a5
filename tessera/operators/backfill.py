"""Additive backfill: int counters add up, other fields replace, retries apply once."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import canonical, int_value, no_fields, version_rank
from tessera.operators.running import TOTAL, running
from tessera.operators.writes import first, met, taken

COMMITTED = "task_id string, entity string, signature string"


def plan(results: DataFrame) -> DataFrame:
    """(entity, fields): the first row of each entity, in bytewise order of entities."""
    return first(results, "fields").orderBy("entity")


def plan_keys(results: DataFrame) -> DataFrame:
    """Entities in order, repeated ones as often as they come."""
    return results.select("entity").orderBy("entity")


def total_bytes(results: DataFrame) -> DataFrame:
    """(total): bytes of all field names and canonical values."""
    long = results.select(F.explode("fields").alias("k", "v"))
    size = F.octet_length("k") + F.octet_length(canonical(F.col("v")))
    return long.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total"))


def signature(task_id: str, results: DataFrame) -> str:
    return f"{task_id}#{total_bytes(results).first().total}"


def added(new: Column, old: Column) -> Column:
    """``new`` with each int that ``old`` holds as an int too added to it. Fields only in ``old`` are dropped; 64-bit overflow is an error."""

    def add(k: Column, v: Column) -> Column:
        before = old[k]
        return F.when((v.type == "int") & (before.type == "int"), int_value(v.i + before.i)).otherwise(v)

    return F.transform_values(new, add)


def _wrapped_sum(a: Column, b: Column) -> Column:
    """a + b of 64-bit integers, which wraps around."""
    half = F.lit(Decimal(2**63))
    total = a.cast("decimal(20,0)") + b.cast("decimal(20,0)") + half
    return (F.pmod(total, F.lit(Decimal(2**64))) - half).cast("bigint")


def doubled(new: Column, old: Column, copies: Column) -> Column:
    """What ``copies`` equal rows in one run come to in the literal behaviour: (old + new) * 2 ** (copies - 1) for int fields, wrapped around at 64 bits as there."""
    times = (copies - 1).cast("int")

    def grow(k: Column, v: Column) -> Column:
        base = _wrapped_sum(v.i, F.coalesce(F.when(old[k].type == "int", old[k].i), F.lit(0)))
        # A shift takes its distance modulo 64.
        grown = F.when(times < 64, F.call_function("shiftleft", base, times)).otherwise(F.lit(0).cast("bigint"))
        return F.when(v.type == "int", int_value(grown)).otherwise(v)

    return F.transform_values(new, grow)


def mark(task_id: str, results: DataFrame) -> Column:
    """The signature as a column of any query, computed with it."""
    return F.concat(F.lit(f"{task_id}#"), total_bytes(results).scalar().cast("string"))


def pending(results: DataFrame, committed: DataFrame, task_id: str) -> DataFrame:
    """Results that this task has not committed under the same signature."""
    done = committed.where(F.col("task_id") == task_id).where(F.col("signature") == mark(task_id, results)).select("entity")
    return results.join(done, "entity", "left_anti")


def run(
    entries: DataFrame, results: DataFrame, version_id: str, at, compat: bool = False, compound: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """(entries after, decisions): additive merge, then guarded replacement, one row for each entity.

    Decisions are (entity, fields, accepted): a stale row counts as processed but
    is not written. With ``compat``, ranks are read as the literal behaviour reads
    them; with ``compound``, by default the same, equal rows of an entity compound.
    Entries and rows are dealt out once and meet in one join.
    """
    compound = compat if compound is None else compound
    new = results.groupBy("entity").agg(F.min_by(F.struct("fields"), "row_no").alias("new"), F.count("*").alias("copies"))
    both = met(entries, new)
    held = F.coalesce("old.fields", no_fields())
    value = doubled(F.col("new.fields"), held, F.col("copies")) if compound else added(F.col("new.fields"), held)
    stored = F.coalesce(version_rank(F.col("old.version_id"), compat), F.lit(0))
    both = both.withColumn("accepted", F.col("new").isNotNull() & (stored <= version_rank(F.lit(version_id), compat)))
    state = F.struct(value.alias("fields"), F.lit(version_id).alias("version_id"), F.lit(at).cast("timestamp_ntz").alias("written_at"))
    decided = both.where("new IS NOT NULL").select("entity", value.alias("fields"), "accepted")
    return taken(both, F.when(F.col("accepted"), state)), decided


def retry(
    entries: DataFrame, results: DataFrame, committed: DataFrame, task_id: str, version_id: str, at, compat: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, committed, decisions) after applying what the task has not committed yet.

    An entity is committed with its first row, so that equal rows never compound
    here; ``compat`` is about ranks only.
    """
    after, decided = run(entries, pending(results, committed, task_id), version_id, at, compat, compound=False)
    new = decided.where("accepted").select(F.lit(task_id).alias("task_id"), "entity", mark(task_id, results).alias("signature"))
    return after, marked(committed, new), decided


def marked(committed: DataFrame, new: DataFrame) -> DataFrame:
    """Commit marks with those of ``new`` in place of earlier ones of the same task and entity."""
    kept = committed.join(new.select("task_id", "entity"), ["task_id", "entity"], "left_anti")
    return kept.select("task_id", "entity", "signature").unionByName(new.select("task_id", "entity", "signature"))


def additive_history(log: DataFrame) -> DataFrame:
    """Running counters over accepted rows (seq, entity, x): a row without x starts the counter anew. A long entity is cut into ranges."""
    return running(log, F.col("x").isNull(), F.col("x"), TOTAL, own=True).withColumnRenamed("_run", "total").drop("_fresh")
