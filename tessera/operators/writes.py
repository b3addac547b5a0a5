"""State changes as folds over an ordered log: replace, merge in a window, guarded replace, delete.

Every fold keeps what decides an entity's state by aggregates that combine
before the shuffle, so that a much-written entity costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import no_fields, only, version_rank, without
from tessera.operators.running import HIGHEST, running

ENTRY = ("entity", "fields", "version_id", "written_at")


def last(log: DataFrame, *columns: str, by: str = "seq", key: str = "entity") -> DataFrame:
    """The last row of each key."""
    picked = F.max_by(F.struct(*columns), by)
    return log.groupBy(key).agg(picked.alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def first(log: DataFrame, *columns: str, by: str = "row_no", key: str = "entity") -> DataFrame:
    picked = F.min_by(F.struct(*columns), by)
    return log.groupBy(key).agg(picked.alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in columns])


#: What an entity has besides its key.
STATE = ENTRY[1:]


def met(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries and changes of the same entities side by side: entity, old (fields, version_id, written_at) and the columns of ``new``, nulls for what is missing.

    One full outer join: each side is read and dealt out once.
    """
    return entries.select("entity", F.struct(*STATE).alias("old")).join(new, "entity", "full_outer")


def taken(both: DataFrame, state: Column) -> DataFrame:
    """Entries from the rows of ``met``: ``state`` where that is not null, else the old one; entities with neither are gone."""
    return both.select("entity", F.coalesce(state, "old").alias("_s")).where("_s IS NOT NULL").select("entity", "_s.*")


def replaced(entries: DataFrame, new: DataFrame) -> DataFrame:
    """``entries`` with those of ``new`` in place of their own."""
    return taken(met(entries, new.select("entity", F.struct(*STATE).alias("new"))), F.col("new"))


def write(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Full replacement, the last of an entity's rows (seq, entity, fields, version_id, written_at) wins."""
    return replaced(entries, last(log, "fields", "version_id", "written_at"))


def delete(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Without those entities; absent ones are no error."""
    return entries.join(keys.select("entity").distinct(), "entity", "left_anti").select(*ENTRY)


def merged(old: Column, patch: Column, window: list[str]) -> Column:
    """``old`` with the window's fields set from ``patch``, or removed where it lacks them."""
    empty = no_fields()
    return F.map_concat(without(F.coalesce(old, empty), window), only(F.coalesce(patch, empty), window))


def merge_write(entries: DataFrame, log: DataFrame, window: list[str]) -> DataFrame:
    """Merge rows that share one window. Each sets or removes every window field, so that an entity's last row decides."""
    both = met(entries, last(log, "fields", "version_id", "written_at").select("entity", F.struct(*STATE).alias("new")))
    made = F.struct(merged(F.col("old.fields"), F.col("new.fields"), window).alias("fields"), "new.version_id", "new.written_at")
    return taken(both, F.when(F.col("new").isNotNull(), made))


def apply_log(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """Fold a mixed log (seq, op, entity, fields, window, version_id, written_at); op is write, merge or delete.

    A write or delete resets an entity. A field's value is its last touch since
    the last reset; version and time are the last row's; an entity whose last row
    is a delete is gone.

    Touches fold by entity and field, then by entity; the entries are met once.
    """
    names = F.when(F.col("op") == "write", F.map_keys("fields")).when(F.col("op") == "merge", F.col("window"))
    # Besides its fields a row touches the entity as a whole: the field without a name.
    names = F.concat(F.coalesce(names, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    rows = ops.select("entity", "op", "version_id", "written_at", F.col("seq").cast("bigint").alias("seq"), "fields", F.explode(names).alias("field"))
    whole = F.col("field").isNull()
    touch = rows.select("entity", "field", "seq", F.struct(F.when(~whole, F.col("fields")[F.col("field")]).alias("value"), F.when(whole, F.struct("op", "version_id", "written_at")).alias("row")).alias("t"),
                        F.when(whole & (F.col("op") != "merge"), F.col("seq")).alias("reset"))
    fields = touch.groupBy("entity", "field").agg(F.max_by("t", "seq").alias("t"), F.max("seq").alias("seq"), F.max("reset").alias("reset"))
    touched = F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "seq", F.col("t.value").alias("value"))))
    ends = fields.groupBy("entity").agg(touched.alias("touched"), F.max("reset").alias("reset"), F.max("t.row").alias("row"))
    both = met(entries, ends)
    since = F.filter("touched", lambda x: x.value.isNotNull() & (F.col("reset").isNull() | (x.seq >= F.col("reset"))))
    kept = F.map_filter(F.coalesce("old.fields", no_fields()), lambda k, _: F.col("reset").isNull() & ~F.array_contains(F.transform("touched", lambda x: x.field), k))
    made = F.map_concat(kept, F.map_from_entries(F.transform(since, lambda x: F.struct(x.field, x.value))))
    state = F.when(F.col("row.op") != "delete", F.struct(made.alias("fields"), "row.version_id", "row.written_at"))
    return taken(both.withColumn("old", F.when(F.col("row.op").isNull() | (F.col("row.op") != "delete"), F.col("old"))), state)


def guarded(log: DataFrame, entries: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """``log`` (seq, entity, version_id, ...) with rank and accepted.

    A row is accepted unless an entity's stored version ranks higher. Accepted
    ranks never fall, so the stored one is the highest before. A row whose column
    ``unguarded`` is true is always accepted and starts anew from its own rank.
    An entity with most of the log is cut into ranges of it, as ``running`` says.
    """
    rows = log.withColumn("rank", version_rank(F.col("version_id"), compat))
    if "unguarded" not in log.columns:
        rows = rows.withColumn("unguarded", F.lit(False))
    before = running(rows, F.coalesce("unguarded", F.lit(False)), F.col("rank"), HIGHEST, own=False)
    stored = F.lit(0).cast("bigint")
    if entries is not None:
        held = entries.select("entity", version_rank(F.col("version_id"), compat).alias("_stored"))
        before = before.join(held, "entity", "left")
        stored = F.coalesce("_stored", F.lit(0)).cast("bigint")
    floor = F.greatest(F.coalesce("_run", F.lit(0)), F.when(F.col("_fresh"), stored).otherwise(0))
    out = before.withColumn("accepted", F.col("unguarded") | (F.col("rank") >= floor)).drop("_run", "_fresh", "_stored")
    return out if "unguarded" in log.columns else out.drop("unguarded")


def compare_and_write(entries: DataFrame, log: DataFrame, compat: bool = False) -> DataFrame:
    """Guarded full replacement by a log.

    The last accepted row is the last one of the highest rank, if that is not
    below the stored rank: an aggregate instead of a chain.
    """
    ranked = log.withColumn("_rank", version_rank(F.col("version_id"), compat))
    top = ranked.groupBy("entity").agg(F.max_by(F.struct(*STATE), F.struct("_rank", "seq")).alias("new"), F.max("_rank").alias("rank"))
    both = met(entries, top)
    stored = F.coalesce(version_rank(F.col("old.version_id"), compat), F.lit(0))
    return taken(both, F.when(stored <= F.col("rank"), F.col("new")))
