"""One object with the whole API: tables, versions, reads, writes, imports, backfills, checks, expiry."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import Expansion, Router, require_entity
from tessera.functions.values import canonical
from tessera.operators import backfill, consistency, ingest, reads, ttl, writes
from tessera.operators.versions import Manager, Version
from tessera.sources.cache import ReadCache
from tessera.sources.catalog import Registry, seeded
from tessera.sources.store import Store

# Defaults of a served engine.
SHARDS, IMPORT_WINDOW, STEP = 16, 32, timedelta(minutes=10)


@dataclass
class Task:
    id: str
    table_id: str
    state: str = "pending"
    total: int = 0
    processed: int = 0
    updated_at: str = ""

    def completed(self) -> bool:
        return self.processed >= self.total


class Engine:
    """State lives under ``path``. With ``compat``, the literal behaviours listed in the README apply.

    Every change is one batch, one generation. Reads of a generation and layout
    are kept in memory on request and dropped with the next change.
    """

    def __init__(
        self, spark: SparkSession, path: str, registry: Registry | None = None, shards: int = SHARDS, expiry: timedelta = ttl.DEFAULT_TTL,
        import_window: int = IMPORT_WINDOW, step: timedelta = STEP, clock: Callable[[], datetime] = datetime.now, compat: bool = False,
    ):
        self.spark, self.store, self.compat, self.clock = spark, Store(spark, path), compat, clock
        self.registry = registry or seeded()
        self.versions = Manager(self.registry, lambda: self.clock(), compat)
        self.router, self.expiry, self.import_window, self.step = Router(shards), expiry, import_window, step
        self.tasks: dict[str, Task] = {}
        self.batches: dict[str, dict] = {}
        self._views: dict[tuple[int, str], DataFrame] = {}
        self._reads = ReadCache()
        #: The last number in the journal.
        self.journal_seq = 0
        self._shards = shards
        self._load()
        self.versions.hooks.append(lambda ids: self.invalidate_all())

    # ------------------------------------------------------------ state

    def _load(self) -> None:
        """What the store's last commit says, the start of all if there is none."""
        held = self.store.meta or {"versions": {"active_id": "", "versions": []}, "tasks": {}, "batches": {}, "shards": self._shards}
        held = json.loads(json.dumps(held))
        self.versions.load_dict(held["versions"])
        self.tasks = {k: Task(**v) for k, v in held["tasks"].items()}
        self.batches, self.router.shards = held["batches"], held["shards"]
        self.journal_seq = held.get("journal_seq", 0)

    def _commit(
        self, entries: tuple[DataFrame, list[int]] | None = None, append: dict[str, DataFrame] | None = None, results: dict[str, DataFrame] | None = None,
        **tables: DataFrame,
    ) -> int:
        """Write the change and everything in memory; if that fails, memory is again what the store has."""
        meta = {
            "versions": self.versions.state_dict(), "tasks": {k: vars(t) for k, t in self.tasks.items()},
            "batches": self.batches, "shards": self.router.shards, "journal_seq": self.journal_seq,
        }
        try:
            return self.store.commit(tables, append, entries, meta, results=results)
        except Exception:
            self._load()
            raise
        finally:
            self.invalidate_all()

    def _touched(self, keys: DataFrame) -> tuple[DataFrame, list[int]]:
        """The entries of the buckets that hold ``keys``, and those buckets: all that a change of the keys reads and rewrites."""
        buckets = self.store.buckets_of(keys)
        return self.store.entries(buckets), buckets

    @property
    def entries(self) -> DataFrame:
        return self.store.entries()

    @property
    def journal(self) -> DataFrame:
        return self.store.table("journal")

    @property
    def committed(self) -> DataFrame:
        return self.store.table("committed")

    def invalidate_all(self) -> None:
        for view in self._views.values():
            view.unpersist()
        self._views = {}
        self._reads.clear()

    def invalidate_entity(self, entity: str) -> None:
        """Forget the snapshots of one entity, whatever their version; whole views hold all entities and go with the next change."""
        self._reads.invalidate_entity(entity)

    def invalidate_version(self, version_id: str) -> None:
        self._reads.invalidate_version(version_id)
        for key in [k for k in self._views if k[1] == version_id]:
            self._views.pop(key).unpersist()

    def cached_view(self, version_id: str = "") -> DataFrame:
        """All entries in a version's layout, kept in memory for this generation."""
        v = self.versions.get(version_id) if version_id else self.versions.resolve_active()
        key = (self.store.generation, v.id if v else version_id)
        if key not in self._views:
            self._views[key] = reads.projected(self.entries, reads.layout(v)).persist()
        return self._views[key]

    def cache_size(self) -> int:
        return len(self._views) + len(self._reads)

    def maintain(self) -> bool:
        """Grow the buckets with the data and gather the journal's parts, where due."""
        done = self.store.maintain()
        if done:
            self.invalidate_all()
        return done

    # ------------------------------------------------------------ versions

    def create_version(self, table_id: str) -> Version:
        v = self.versions.create(table_id)
        self._commit()
        return v

    def publish(self, version_id: str) -> Version:
        v = self.versions.publish(version_id)
        self._commit()
        return v

    def rollback_version(self, version_id: str) -> Version:
        parent = self.versions.rollback(version_id)
        self._commit()
        return parent

    # ------------------------------------------------------------ reads

    def read(self, keys: DataFrame, version_id: str = "", few: bool = False) -> DataFrame:
        """Snapshots of ``keys`` (entity) in the active version's layout, or a named one's; ``few`` keys read their buckets only."""
        v = self.versions.get(version_id) if version_id else self.versions.resolve_active()
        entries = self._touched(keys)[0] if few else self.entries
        return reads.read(keys, entries, v, version_id or (v.id if v else ""))

    def get(self, entity: str, version_id: str = "") -> dict | None:
        """Canonical texts of one entity's fields in a layout, None if it is not there; kept until a change, absent ones too."""
        v = self.versions.get(version_id) if version_id else self.versions.resolve_active()
        shown = version_id or (v.id if v else "")
        known, found = self._reads.get(entity, shown)
        if not known:
            keys = self.spark.createDataFrame([(entity,)], "entity string")
            stored = reads.projected(reads.entry_for(keys, self._touched(keys)[0]), reads.layout(v))
            row = stored.select("version_id", F.transform_values("fields", lambda _, x: canonical(x)).alias("fields")).first()
            found = None if row.fields is None else dict(row.fields)
            self._reads.put(entity, shown, found)
        return found

    def read_strings(self, keys: DataFrame, version_id: str = "") -> DataFrame:
        return self.read(keys, version_id).withColumn("fields", F.transform_values("fields", lambda _, v: canonical(v)))

    def entry_for(self, keys: DataFrame) -> DataFrame:
        return reads.entry_for(keys, self.entries)

    def written_at(self, keys: DataFrame) -> DataFrame:
        return reads.written_at(keys, self.entries)

    def keys(self, shard: int) -> DataFrame:
        return reads.keys_of(self.entries, shard, self.router.shards)

    def to_wide(self, table_id: str) -> DataFrame:
        return self.registry.must_get(table_id).to_wide(self.entries)

    # ------------------------------------------------------------ writes

    def _valid(self, rows: DataFrame, column: str = "entity") -> DataFrame:
        """Keys trimmed and checked; as they are with ``compat``."""
        return rows if self.compat else rows.withColumn(column, require_entity(F.col(column)))

    @contextmanager
    def _log(self, rows: DataFrame, version_id: str | None, at: datetime | None):
        """The rows as a log, written once. Without a column seq, rows of one key have an order by their content, the same in every run."""
        out = self._valid(rows)
        if "seq" not in out.columns:
            out = out.withColumn("seq", F.xxhash64(F.to_json(F.array_sort(F.map_entries("fields")))))
        if version_id is not None:
            out = out.withColumn("version_id", F.lit(version_id))
        if "written_at" not in out.columns:
            out = out.withColumn("written_at", F.lit(at or self.clock()).cast("timestamp_ntz"))
        with self.store.staged(out) as log:
            yield (log, *self._touched(log))

    def write(self, rows: DataFrame, version_id: str | None = None, at: datetime | None = None) -> int:
        """Replace entities by rows (entity, fields), in order of a column seq if there is one."""
        with self._log(rows, version_id, at) as (log, before, buckets):
            return self._commit((writes.write(before, log), buckets))

    def merge_write(self, rows: DataFrame, window: list[str], version_id: str, at: datetime | None = None) -> int:
        with self._log(rows, version_id, at) as (log, before, buckets):
            return self._commit((writes.merge_write(before, log, window), buckets))

    def compare_and_write(self, rows: DataFrame, version_id: str | None = None, at: datetime | None = None) -> DataFrame:
        """Guarded replacement; the log with a column accepted, as it was decided, readable until the second change after this one."""
        with self._log(rows, version_id, at) as (log, before, buckets):
            decided = writes.guarded(log, before, self.compat)
            self._commit((writes.compare_and_write(before, log, self.compat), buckets), results={"verdicts": decided})
        return self.store.result("verdicts")

    def apply_log(self, ops: DataFrame) -> int:
        with self.store.staged(ops) as log:
            before, buckets = self._touched(log)
            return self._commit((writes.apply_log(before, log), buckets))

    def delete(self, keys: DataFrame) -> int:
        with self.store.staged(keys.select("entity").distinct()) as gone:
            before, buckets = self._touched(gone)
            return self._commit((writes.delete(before, gone), buckets))

    # ------------------------------------------------------------ imports

    def import_rows(self, batch_id: str, table_id: str, rows: DataFrame, version_id: str, at: datetime | None = None) -> dict:
        """Import rows (row_no from 0, entity, fields) in the window of fields that rows and table share."""
        if not batch_id:
            raise ValueError("empty batch id")
        table = self.registry.must_get(table_id)
        with self.store.staged(self._valid(rows)) as rows:
            size = rows.agg(F.count("*").alias("n"), F.max("row_no").alias("last")).first()
            if not size.n:
                raise ValueError("no rows to import")
            window = ingest.field_window(rows, table)
            before, buckets = self._touched(rows)
            ops = ingest.journal_of(before, rows, batch_id, self.journal_seq + 1, self.import_window)
            width = self.import_window if self.import_window > 0 else ingest.DEFAULT_WINDOW
            self.batches[batch_id] = {"version_id": version_id, "segments": -(-size.n // width), "rows": size.n, "failed": False}
            self.journal_seq += size.last + 1
            after = ingest.import_batch(before, rows, window, version_id, at or self.clock())
            self._commit((after, buckets), append={"journal": ops})
        return self.batches[batch_id]

    def rollback_import(self, batch_id: str) -> None:
        """Restore the batch's entities; a second call changes nothing."""
        if batch_id not in self.batches:
            raise KeyError(f"unknown batch {batch_id}")
        self.batches[batch_id]["failed"] = True
        before, buckets = self._touched(ingest.ops_for(self.journal, batch_id))
        self._commit((ingest.rollback(before, self.journal, batch_id), buckets), journal=ingest.cleared(self.journal, batch_id))

    def batch(self, batch_id: str) -> dict | None:
        return self.batches.get(batch_id)

    def clear_batch(self, batch_id: str) -> None:
        self.batches.pop(batch_id, None)
        self._commit(journal=ingest.cleared(self.journal, batch_id))

    # ------------------------------------------------------------ backfill

    def backfill(self, task_id: str, version_id: str, rows: DataFrame, at: datetime | None = None) -> int:
        """Run a task over rows (row_no, entity, fields); the number of entities written."""
        if not task_id:
            raise ValueError("empty task id")
        v = self.versions.must_get(version_id)
        now = at or self.clock()
        with self.store.staged(self._valid(rows)) as rows:
            before, buckets = self._touched(rows)
            after, decided = backfill.run(before, rows, v.id, now, self.compat)
            counts = decided.agg(F.count_if("accepted").alias("written"), F.count("*").alias("n")).first()
            total = rows.count() if self.compat else counts.n
            state = "done" if total and counts.n >= 1 else "running"
            self.tasks[task_id] = Task(task_id, v.table_id, state, total, total, now.isoformat())
            tables = {}
            if not self.compat:
                new = decided.where("accepted").select(F.lit(task_id).alias("task_id"), "entity", backfill.mark(task_id, rows).alias("signature"))
                tables["committed"] = backfill.marked(self.committed, new)
            self._commit((after, buckets), **tables)
        return counts.written

    def retry(self, task_id: str, version_id: str, rows: DataFrame, at: datetime | None = None) -> int:
        """Apply what the task has not committed under the rows' signature; the number of entities written."""
        v = self.versions.must_get(version_id)
        with self.store.staged(self._valid(rows)) as rows:
            before, buckets = self._touched(rows)
            after, committed, decided = backfill.retry(before, rows, self.committed, task_id, v.id, at or self.clock(), self.compat)
            written = decided.where("accepted").count()
            self._commit((after, buckets), committed=committed)
        return written

    def task(self, task_id: str) -> Task | None:
        return self.tasks.get(task_id)

    # ------------------------------------------------------------ the rest

    def expand(self, shards: int) -> Expansion:
        change = self.router.expand(shards)
        self._commit()
        return change

    def check(
        self, begin: datetime, until: datetime, offline: DataFrame | Callable[[str], dict | None] | None = None, both: bool = False
    ) -> DataFrame:
        """Differences to an offline view, a table (entity, fields) or a function of the key, over windows between version switches or steps."""
        spans = consistency.windows(self.spark, self.versions, begin, until, self.step)
        other = self.entries.where("false") if offline is None else consistency.offline_view(self.entries, offline) if callable(offline) else offline
        return consistency.check(self.entries, other, spans, self.versions.resolve_active(), both)

    def scan_expired(self, now: datetime | None = None) -> int:
        """Remove entries past their time; how many went."""
        now = now or self.clock()
        old = ttl.expired(self.entries, now, self.expiry)
        n = old.count()
        if n:
            before, buckets = self._touched(old)
            self._commit((ttl.survivors(before, now, self.expiry), buckets))
        return n

    def expire_key(self, key: str, now: datetime | None = None) -> bool:
        before, _ = self._touched(self.spark.createDataFrame([(key,)], "entity string"))
        gone = ttl.expired(before.where(F.col("entity") == key), now or self.clock(), self.expiry)
        if gone.isEmpty():
            return False
        self.delete(gone.select("entity"))
        return True

    def health(self) -> dict:
        return {"ok": True, "tables": self.registry.count(), "shards": self.router.shards, "generation": self.store.generation}


def demo(spark: SparkSession, path: str, **options) -> Engine:
    """The two built-in tables, the first one's version published, the second one's a draft."""
    engine = Engine(spark, path, **options)
    engine.publish(engine.create_version("user_profile").id)
    engine.create_version("item_profile")
    return engine


