"""Queries that go through the engine and its stored generations, with the SQL of the same changes."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine, Task
from tessera.functions.times import micros
from tessera.functions.values import bool_value, fields_of, float_value, int_value, quoted, string_value, without
from tessera.plans import catalogue
from tessera.plans.adapters import OPLOG, PROFILE, counters, oplog, profile, table
from tessera.plans.catalogue import AT, ORACLE, field, query
from tessera.sources.catalog import Field, Table
from tessera.sources.shared import shared_dir
from tessera.streaming.upsert import upsert


def _engine(spark: SparkSession, **options) -> Engine:
    """A new engine in a folder of its own, its clock a second further at each look."""
    seconds = iter(range(10**6))
    place = f"{shared_dir(spark)}/tessera-engine/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    return Engine(spark, place, clock=lambda: AT + timedelta(seconds=next(seconds)), **options)


def _again(engine: Engine) -> Engine:
    """What another process finds in the engine's folder."""
    return Engine(engine.spark, engine.store.path)


def _held(spark: SparkSession, d: str, entries: DataFrame | None = None, **options) -> Engine:
    engine = _engine(spark, **options)
    engine.write(profile(spark, d) if entries is None else entries)
    return engine


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return oplog(spark, d).select(F.col("seq").alias("row_no"), "entity", "fields")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return oplog(spark, d).select("seq", "entity", "fields", "version_id", "written_at")


_LAST = "lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq DESC) AS rn FROM oplog) WHERE rn = 1)"


@query(
    "SELECT coalesce(p.entity, l.entity) AS entity, coalesce(l.version_id, 'user_profile-v1') AS version_id, CASE WHEN l.entity IS NULL THEN age END AS age, field, value, CAST(CASE WHEN l.entity IS NULL THEN 6 ELSE 1 END AS BIGINT) AS n_fields, "
    "coalesce(l.us, p.us) AS written_us FROM profile p FULL OUTER JOIN lasts l ON p.entity = l.entity", PROFILE, OPLOG, _LAST,
)
def engine_write(spark: SparkSession, d: str) -> DataFrame:
    """Two writes, read by another engine."""
    engine = _held(spark, d)
    engine.write(_log(spark, d))
    name = F.when(F.size("fields") == 1, F.map_keys("fields")[0])
    found = _again(engine).entries.withColumn("field", name)
    return found.select("entity", "version_id", field("age", "i").alias("age"), "field", F.col("fields")[F.col("field")].f.alias("value"), F.size("fields").cast("bigint").alias("n_fields"), micros(F.col("written_at")).alias("written_us"))


@query(ORACLE["merge_window_delete"])
def engine_merge(spark: SparkSession, d: str) -> DataFrame:
    """Merges within a window, through the engine."""
    engine, c = _held(spark, d), table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    name = F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("user_"), key)).when(F.col("c_acctbal") < 0, F.concat(F.lit("user_new"), key))
    patch = c.select(name.alias("entity"), fields_of(city=string_value(F.lit("moved")), other=int_value(F.lit(1))).alias("fields")).where("entity IS NOT NULL")
    engine.merge_write(patch, ["city", "level"], "user_profile-v1")
    return _again(engine).entries.select("entity", field("age", "i").alias("age"), field("city", "s").alias("city"), field("level", "i").alias("level"))


@query(ORACLE["cas_accept"])
def engine_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The stored verdicts of a guarded log."""
    return _engine(spark).compare_and_write(_log(spark, d)).select("seq", "entity", "rank", "accepted")


@query(ORACLE["cas_final_state"])
def engine_guarded_state(spark: SparkSession, d: str) -> DataFrame:
    """M3: what a guarded log leaves in the store."""
    engine = _engine(spark)
    engine.compare_and_write(_log(spark, d))
    long = _again(engine).entries.select("entity", F.explode("fields").alias("field", "v"), "version_id")
    return long.select("entity", "field", F.col("v.f").alias("value"), "version_id")


@query(ORACLE["cas_final_state"])
def engine_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same log as a stream of files, a batch delivered twice included."""
    engine = _engine(spark)
    source, log = f"{engine.store.path}-source", _log(spark, d)
    log.coalesce(1).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(log.schema).parquet(source)
        upsert(stream, engine, f"{engine.store.path}-progress", "guarded").awaitTermination()
    long = _again(engine).entries.select("entity", F.explode("fields").alias("field", "v"), "version_id")
    return long.select("entity", "field", F.col("v.f").alias("value"), "version_id")


@query(ORACLE["mixed_log"])
def engine_log(spark: SparkSession, d: str) -> DataFrame:
    """A mixed log, through the engine."""
    op = F.when(F.col("seq") % 11 == 0, "delete").when(F.col("seq") % 5 == 0, "write").otherwise("merge")
    engine = _engine(spark)
    engine.apply_log(oplog(spark, d).withColumns({"op": op, "window": F.array("field")}))
    return _again(engine).entries.select("entity", F.explode("fields").alias("field", "v")).select("entity", "field", F.col("v.f").alias("value"))


@query(ORACLE["delete_entities"])
def engine_delete(spark: SparkSession, d: str) -> DataFrame:
    """M4: removal through the engine."""
    engine = _held(spark, d)
    engine.delete(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("entity")))
    return _again(engine).entries.select("entity", field("age", "i").alias("age"))


def _import(spark: SparkSession, d: str) -> Engine:
    before = profile(spark, d).withColumn("fields", F.map_concat("fields", fields_of(click=float_value(F.lit(-1.0)), view=float_value(F.lit(-2.0)))))
    engine = _held(spark, d, before)
    engine.registry.register(catalogue._EVENTS_TABLE)
    engine.import_rows("b1", "events", _rows(spark, d), "user_profile-v2")
    return engine


@query(ORACLE["import_merge"])
def engine_import(spark: SparkSession, d: str) -> DataFrame:
    """An import through the engine."""
    after = _again(_import(spark, d)).entries
    return after.select("entity", field("age", "i").alias("age"), *[field(n, "f").alias(n) for n in ("click", "purchase", "view")], "version_id")


@query("SELECT CAST(event_id + 1 AS BIGINT) AS journal_seq, CAST(event_id // 32 AS INTEGER) AS segment, concat('user_', CAST(user_id AS VARCHAR)) AS entity, user_id IN (SELECT c_custkey FROM customer) AS existed FROM events WHERE event_id = (SELECT min(event_id) FROM events e WHERE e.user_id = events.user_id)")
def engine_journal(spark: SparkSession, d: str) -> DataFrame:
    """The journal that an import leaves."""
    return _again(_import(spark, d)).journal.select("journal_seq", "segment", "entity", F.col("before").isNotNull().alias("existed"))


@query(ORACLE["import_rollback"])
def engine_rollback(spark: SparkSession, d: str) -> DataFrame:
    """An import taken back by another engine, twice."""
    engine = _again(_import(spark, d))
    engine.rollback_import("b1")
    engine.rollback_import("b1")
    back = _again(engine).entries
    return back.select("entity", field("age", "i").alias("age"), field("click", "f").alias("click"), "version_id", micros(F.col("written_at")).alias("written_us"))


@query(
    "SELECT * FROM (SELECT count(*) AS rows, CAST(ceil(count(*) / 32.0) AS BIGINT) AS segments FROM events) , (VALUES ('imported', false, true), ('rolled back', true, false)) t(step, failed, journalled) "
    "UNION ALL SELECT 0, 0, 'cleared', NULL, false"
)
def engine_batches(spark: SparkSession, d: str) -> DataFrame:
    """A batch's record after the import, its rollback, and when cleared."""
    engine, seen = _import(spark, d), []

    def look(step: str) -> None:
        batch = _again(engine).batch("b1") or {"rows": 0, "segments": 0, "failed": None}
        seen.append((batch["rows"], batch["segments"], step, batch["failed"], not engine.journal.isEmpty()))

    look("imported")
    engine.rollback_import("b1")
    look("rolled back")
    engine.clear_batch("b1")
    look("cleared")
    return spark.createDataFrame(seen, "rows bigint, segments bigint, step string, failed boolean, journalled boolean")


def _filled(spark: SparkSession, d: str, **options) -> Engine:
    engine = _held(spark, d, **options)
    for name in ("user_profile", "user_profile", "user_profile"):
        engine.create_version(name)
    return engine


@query(ORACLE["backfill_additive"])
def engine_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A backfill through the engine, and retries that find nothing left."""
    engine = _filled(spark, d)
    engine.backfill("t", "user_profile-v3", counters(spark, d))
    again = _filled_versions(engine)
    again.retry("t", "user_profile-v3", counters(spark, d))
    after = _again(again).entries
    return after.select("entity", field("active_days", "i").alias("active_days"), field("tag", "s").alias("tag"), field("age", "i").alias("age"), "version_id")


def _filled_versions(engine: Engine) -> Engine:
    found = _again(engine)
    found.clock = engine.clock
    return found


@query(
    "SELECT coalesce(f.entity, p.entity) AS entity, CASE WHEN f.entity IS NULL OR held_rank > 21 THEN p.active_days ELSE x + coalesce(p.active_days, 0) END AS active_days, coalesce(f.entity IS NOT NULL AND coalesce(held_rank, 0) <= 21, false) AS written "
    "FROM firsts f FULL OUTER JOIN (SELECT *, CAST(reverse(CAST(11 + c_custkey % 3 AS VARCHAR)) AS BIGINT) AS held_rank FROM profile) p ON f.entity = p.entity",
    PROFILE, catalogue._FIRST,
)
def engine_retry_compat(spark: SparkSession, d: str) -> DataFrame:
    """A retry with ranks read backwards, 12 as 21: entries of version 13 (31) reject it, those of 11 and 12 do not; an entity's first row counts once."""
    version = F.concat(F.lit("user_profile-v"), (11 + F.substr(F.col("entity"), F.lit(6)).cast("bigint") % 3).cast("string"))
    engine = _held(spark, d, profile(spark, d).withColumn("version_id", version), compat=True)
    for _ in range(12):
        engine.versions.create("user_profile")
    engine.retry("t", "user_profile-v12", counters(spark, d))
    engine.retry("t", "user_profile-v12", counters(spark, d))
    after = _again(engine).entries
    return after.select("entity", field("active_days", "i").alias("active_days"), F.col("fields")["tag"].isNotNull().alias("written"))


@query("SELECT 't' AS id, 'user_profile' AS table_id, 'done' AS state, count(DISTINCT user_id) AS total, count(DISTINCT user_id) AS processed, true AS completed, count(DISTINCT user_id) AS written, true AS unknown_is_none FROM events")
def engine_task(spark: SparkSession, d: str) -> DataFrame:
    """A task's record, as another engine finds it."""
    engine = _filled(spark, d)
    written = engine.backfill("t", "user_profile-v3", counters(spark, d))
    again = _again(engine)
    t = again.task("t")
    row = (t.id, t.table_id, t.state, t.total, t.processed, t.completed(), written, again.task("u") is None)
    return spark.createDataFrame([row], "id string, table_id string, state string, total bigint, processed bigint, completed boolean, written bigint, unknown_is_none boolean")


@query("SELECT * FROM (VALUES (10, 10, true), (10, 9, false), (0, 0, true)) t(total, processed, completed)")
def task_completion(spark: SparkSession, d: str) -> DataFrame:
    """F15."""
    tasks = [Task("t", "", "", *x) for x in ((10, 10), (10, 9), (0, 0))]
    return spark.createDataFrame([(t.total, t.processed, t.completed()) for t in tasks], "total int, processed int, completed boolean")


@query(ORACLE["ttl_survivors"])
def engine_expire(spark: SparkSession, d: str) -> DataFrame:
    """A scan for old entries through the engine."""
    engine = _held(spark, d, expiry=catalogue._TTL)
    engine.scan_expired(catalogue._NOW)
    return _again(engine).entries.select("entity", field("age", "i").alias("age"))


@query("SELECT entity, age FROM profile", PROFILE)
def engine_view(spark: SparkSession, d: str) -> DataFrame:
    """The view of the active version, kept in memory, hides what is not in its layout."""
    engine = _held(spark, d)
    engine.registry.register(Table("ages", "ages", (Field("age", "int"),)))
    engine.publish(engine.create_version("ages").id)
    seen = engine.cached_view()
    return seen.where(F.size("fields") == 1).select("entity", field("age", "i").alias("age"))


@query(
    "SELECT * FROM (VALUES (0, 'three reads, one absent', 3), (1, 'the same again', 3), (2, 'one entity dropped', 2), (3, 'version dropped', 0), (4, 'read again', 1), (5, 'published', 0), (6, 'a view and a read', 2), (7, 'all dropped', 0), (8, 'read', 1), (9, 'written', 0)) t(step, what, kept)"
)
def engine_cache(spark: SparkSession, d: str) -> DataFrame:
    """What is kept after reads, by drops and by changes."""
    engine, seen = _held(spark, d), []
    v = engine.create_version("user_profile")
    note = lambda what: seen.append((len(seen), what, engine.cache_size()))
    for what in ("three reads, one absent", "the same again"):
        found = [engine.get(k, v.id) for k in ("user_1", "user_2", "nobody")]
        if found[2] is not None or len(found[0]) != 6:
            raise AssertionError(found)
        note(what)
    engine.invalidate_entity("user_1")
    note("one entity dropped")
    engine.invalidate_version(v.id)
    note("version dropped")
    engine.get("user_1", v.id)
    note("read again")
    engine.publish(v.id)
    note("published")
    engine.cached_view()
    engine.get("user_1")
    note("a view and a read")
    engine.invalidate_all()
    note("all dropped")
    engine.get("user_1")
    note("read")
    engine.delete(spark.createDataFrame([("user_1",)], "entity string"))
    note("written")
    return spark.createDataFrame(seen, "step int, what string, kept int")


@query(
    "SELECT entity, 'age' AS field, CAST(c_custkey // 10 AS INTEGER) AS \"window\", CAST(age AS VARCHAR) AS online, CASE WHEN c_custkey % 2 = 1 THEN '' ELSE '0' END AS offline FROM profile WHERE (c_custkey % 2 = 1 OR c_custkey % 3 = 0) AND us < (SELECT max(us) FROM profile)",
    PROFILE,
)
def engine_check(spark: SparkSession, d: str) -> DataFrame:
    """The offline view as a function of the key; without a published version all fields count, by steps of ten minutes."""
    entries = profile(spark, d).withColumn("fields", F.map_filter("fields", lambda k, _: k == "age"))
    engine = _held(spark, d, entries)

    def offline(key: str) -> dict | None:
        k = int(key[5:])
        return None if k % 2 else {"age": 18 + k % 60 if k % 3 else 0}

    return engine.check(datetime(2024, 1, 1), catalogue._last(spark, d), offline)


@query("SELECT * FROM (VALUES ('a', 1706745600000000 + 1000000), ('b', 1706745600000000 + 86400000000), ('c', 1706745600000000 + 2000000)) t(entity, written_us)")
def engine_clock(spark: SparkSession, d: str) -> DataFrame:
    """Times come from the engine's clock unless they are given."""
    engine = _engine(spark)
    one = lambda k: spark.range(1).select(F.lit(k).alias("entity"), fields_of(x=int_value(F.lit(1))).alias("fields"))
    engine.clock()
    engine.write(one("a"), "v")
    engine.write(one("b"), "v", AT + timedelta(days=1))
    engine.write(one("c"), "v")
    return _again(engine).entries.select("entity", micros(F.col("written_at")).alias("written_us"))


@query("SELECT * FROM (VALUES (0, 2, 16, 1, 'user_profile-v1', 'draft'), (1, 2, 64, 1, 'user_profile-v1', 'draft')) t(step, tables, shards, published, active, second)")
def engine_wiring(spark: SparkSession, d: str) -> DataFrame:
    """The built-in tables and versions of a new engine, and its shards after an expansion, in another engine."""
    from tessera.engine import demo

    engine, seen = demo(spark, f"{shared_dir(spark)}/tessera-engine/{uuid.uuid4().hex}"), []
    for step in (0, 1):
        again = _again(engine)
        published = sum(v.state == "published" for v in again.versions.list())
        seen.append((step, again.health()["tables"], again.health()["shards"], published, again.versions.resolve_active().id, again.versions.get("item_profile-v2").state))
        engine.expand(64) if not step else None
    return spark.createDataFrame(seen, "step int, tables int, shards int, published int, active string, second string")


# ------------------------------------------------------------ small functions


@query("SELECT * FROM (VALUES ('good', true, 1), ('blank id', false, 0), ('blank field', false, 0), ('same name twice', false, -1), ('unknown type', false, 0)) t(what, valid, place_of_b)")
def table_validation(spark: SparkSession, d: str) -> DataFrame:
    """which tables may be registered, and where their field b is."""
    cases = {
        "good": Table("t", "t", (Field("a", "int"), Field("b", "string"))), "blank id": Table(" ", "t", (Field("b", "int"),)), "blank field": Table("t", "t", (Field("b", "int"), Field(" ", "int"))),
        "same name twice": Table("t", "t", (Field("a", "int"), Field("a ", "string"))), "unknown type": Table("t", "t", (Field("b", "date"),)),
    }

    def valid(t: Table) -> bool:
        try:
            t.validate()
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(k, valid(t), t.field_index("b")) for k, t in cases.items()], "what string, valid boolean, place_of_b int")


@query("SELECT c_custkey, CAST(to_json(concat(c_name, chr(34), chr(92), chr(9), c_mktsegment)) AS VARCHAR) AS name FROM customer")
def quoted_names(spark: SparkSession, d: str) -> DataFrame:
    """names as JSON strings."""
    name = F.concat("c_name", F.lit('"\\\t'), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", quoted(name).alias("name"))


@query("SELECT entity, unnest(['active_days', 'level', 'score', 'is_vip']) AS field FROM profile", PROFILE)
def fields_outside_a_layout(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the fields without a layout's."""
    return profile(spark, d).select("entity", F.explode(F.map_keys(without(F.col("fields"), ["age", "city"]))).alias("field"))


@query(
    "SELECT c_custkey, 'string' AS type, c_name AS s, CAST(NULL AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS BOOLEAN) AS b FROM customer UNION ALL SELECT c_custkey, 'int', NULL, c_custkey, NULL, NULL FROM customer "
    "UNION ALL SELECT c_custkey, 'float', NULL, NULL, c_acctbal, NULL FROM customer UNION ALL SELECT c_custkey, 'bool', NULL, NULL, NULL, c_acctbal > 0 FROM customer"
)
def value_constructors(spark: SparkSession, d: str) -> DataFrame:
    """each kind of value fills its own slot."""
    made = F.array(string_value(F.col("c_name")), int_value(F.col("c_custkey")), float_value(F.col("c_acctbal")), bool_value(F.col("c_acctbal") > 0))
    return table(spark, d, "customer").select("c_custkey", F.inline(made))
