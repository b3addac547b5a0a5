from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine, demo
from tessera.functions.values import ENTRIES, VALUE, fields_of, float_value, int_value, string_value
from tessera.operators import consistency
from tessera.sources.catalog import Field, Table
from tessera.sources.rows import read_json_rows
from tessera.sources.shared import shared_dir
from tessera.streaming.upsert import upsert

T0 = datetime(2024, 1, 1)


@pytest.fixture
def engine(spark, tmp_path):
    now = [T0]

    def clock():
        now[0] += timedelta(seconds=1)
        return now[0]

    return Engine(spark, f"file://{tmp_path}/state", import_window=2, clock=clock)


def rows(spark, **entities):
    frames = [spark.range(1).select(F.lit(i).cast("bigint").alias("row_no"), F.lit(k).alias("entity"), f.alias("fields")) for i, (k, f) in enumerate(entities.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity string")


def shown(frame):
    return {r.entity: dict(r.fields) for r in frame.collect()}


def test_layouts_hide_and_show(spark, engine):
    engine.registry.register(Table("t", "t", (Field("age", "int"),)))
    v1 = engine.create_version("t")
    engine.publish(v1.id)
    engine.write(rows(spark, u=fields_of(age=int_value(F.lit(44)), score=float_value(F.lit(2.25)))), v1.id)
    assert shown(engine.read_strings(keys(spark, "u"))) == {"u": {"age": "44"}}
    engine.registry.register(Table("t", "t", (Field("age", "int"), Field("score", "float"))))
    v2 = engine.create_version("t")
    engine.publish(v2.id)
    assert shown(engine.read_strings(keys(spark, "u"))) == {"u": {"age": "44", "score": "2.25"}}
    assert shown(engine.read_strings(keys(spark, "u"), v1.id)) == {"u": {"age": "44"}}
    assert v1.state == "superseded"
    engine.rollback_version(v2.id)
    assert shown(engine.read_strings(keys(spark, "u"))) == {"u": {"age": "44"}}


def test_absent_entities_are_empty(spark, engine):
    v = engine.create_version("user_profile")
    engine.publish(v.id)
    r = engine.read(keys(spark, "nobody")).first()
    assert (r.entity, r.version_id, r.fields) == ("nobody", v.id, {})
    assert engine.entry_for(keys(spark, "nobody")).first().fields is None


def test_keys_are_checked(spark, engine):
    with pytest.raises(Exception, match="empty entity key"):
        engine.write(rows(spark, **{"  ": fields_of(a=int_value(F.lit(1)))}), "v")
    engine.write(rows(spark, **{" ok ": fields_of(a=int_value(F.lit(1)))}), "v")
    assert [r.entity for r in engine.entries.collect()] == ["ok"]


def test_import_rollback_and_reload(spark, engine, tmp_path):
    engine.write(rows(spark, user_a=fields_of(age=int_value(F.lit(1)))), "user_profile-v0", T0)
    batch = rows(spark, **{f"user_{k}": fields_of(age=int_value(F.lit(x)), odd=int_value(F.lit(1))) for k, x in zip("apq", (61, 17, 8), strict=True)})
    assert engine.import_rows("b", "user_profile", batch, "user_profile-v1")["segments"] == 2
    assert {r.entity: r.fields["age"].i for r in engine.entries.collect()} == {"user_a": 61, "user_p": 17, "user_q": 8}
    assert all("odd" not in r.fields for r in engine.entries.collect())
    again = Engine(spark, f"file://{tmp_path}/state")
    assert again.batch("b")["rows"] == 3 and again.entries.count() == 3
    again.rollback_import("b")
    r = again.entries.collect()
    assert [(x.entity, x.fields["age"].i, x.version_id, x.written_at) for x in r] == [("user_a", 1, "user_profile-v0", T0)]
    again.rollback_import("b")
    assert again.entries.count() == 1 and again.batch("b")["failed"]
    for bad in (("", batch), ("x", batch.where("false"))):
        with pytest.raises(ValueError):
            again.import_rows(bad[0], "user_profile", bad[1], "v")
    with pytest.raises(KeyError):
        again.rollback_import("unknown")
    with pytest.raises(KeyError):
        again.import_rows("y", "unknown", batch, "v")
    again.clear_batch("b")
    assert again.batch("b") is None


def test_backfill_applies_once(spark, engine):
    v = engine.create_version("user_profile")
    batch = rows(spark, shop_4=fields_of(hits=int_value(F.lit(13))), shop_9=fields_of(hits=int_value(F.lit(6))))
    assert engine.backfill("t", v.id, batch) == 2
    task = engine.task("t")
    assert (task.state, task.processed, task.completed()) == ("done", 2, True)
    assert engine.retry("t", v.id, batch) == 0
    assert engine.retry("other", v.id, batch) == 2
    assert {r.entity: r.fields["hits"].i for r in engine.entries.collect()} == {"shop_4": 26, "shop_9": 12}
    with pytest.raises(ValueError):
        engine.backfill("", v.id, batch)
    with pytest.raises(KeyError):
        engine.backfill("t", "none-v1", batch)
    assert engine.task("missing") is None


def test_expansion_keeps_entries_reachable(spark, engine):
    engine.write(rows(spark, a=fields_of(x=int_value(F.lit(1)))), "v")
    assert engine.expand(64).added == 48
    assert engine.read(keys(spark, "a")).first().fields["x"].i == 1
    assert engine.keys(64).count() == 0 and engine.health()["shards"] == 64


def test_expiry(spark, engine):
    engine.expiry = timedelta(seconds=60)
    engine.write(rows(spark, old=fields_of(x=int_value(F.lit(1)))), "v", T0 - timedelta(seconds=120))
    engine.write(rows(spark, new=fields_of(x=int_value(F.lit(1)))), "v", T0 - timedelta(seconds=10))
    assert engine.scan_expired(T0) == 1
    assert [r.entity for r in engine.entries.collect()] == ["new"]
    assert not engine.expire_key("new", T0) and engine.expire_key("new", T0 + timedelta(hours=1))


def test_views_are_dropped_by_changes(spark, engine):
    v = engine.create_version("user_profile")
    engine.publish(v.id)
    engine.write(rows(spark, a=fields_of(age=int_value(F.lit(1)))), v.id)
    assert engine.cached_view().count() == 1 and engine.cache_size() == 1
    engine.invalidate_version(v.id)
    assert engine.cache_size() == 0
    engine.cached_view()
    engine.delete(keys(spark, "a"))
    assert engine.cache_size() == 0 and engine.cached_view().count() == 0


def test_check(spark, engine):
    engine.write(rows(spark, u=fields_of(age=int_value(F.lit(1)), city=string_value(F.lit("x")))), "v", T0 + timedelta(minutes=25))
    assert engine.check(T0, T0 + timedelta(minutes=20)).count() == 0
    got = {(r.field, r.window, r.online, r.offline) for r in engine.check(T0, T0 + timedelta(hours=1)).collect()}
    assert got == {("age", 2, "1", ""), ("city", 2, "x", "")}
    other = rows(spark, u=fields_of(age=string_value(F.lit("1")), extra=int_value(F.lit(5)))).select("entity", "fields")
    assert {r.field for r in engine.check(T0, T0 + timedelta(hours=1), other).collect()} == {"city"}
    assert {r.field for r in engine.check(T0, T0 + timedelta(hours=1), other, both=True).collect()} == {"city", "extra"}
    with pytest.raises(ValueError):
        engine.check(T0, T0)


def test_partition(spark):
    w = consistency.partition(spark, T0, T0 + timedelta(minutes=100), timedelta(minutes=30)).collect()
    assert len(w) == 4 and w[-1].end == T0 + timedelta(minutes=100)
    assert len(consistency.partition(spark, T0, T0 + timedelta(minutes=60), timedelta(minutes=30)).collect()) == 2
    with pytest.raises(ValueError):
        consistency.partition(spark, T0, T0 + timedelta(minutes=1), timedelta(0))


def test_windows_between_switches(spark, engine):
    a, b = engine.create_version("user_profile"), engine.create_version("user_profile")
    engine.publish(a.id)
    engine.publish(b.id)
    w = consistency.windows(spark, engine.versions, T0, T0 + timedelta(hours=1)).orderBy("window").collect()
    assert [x.begin for x in w][1:] == [x.end for x in w][:-1] and w[-1].end == T0 + timedelta(hours=1) and len(w) == 3


def test_demo(spark, tmp_path):
    e = demo(spark, f"file://{tmp_path}/demo")
    assert e.versions.resolve_active().id == "user_profile-v1" and e.versions.get("item_profile-v2").state == "draft"
    assert e.to_wide("item_profile").columns == ["entity", "category", "price", "stock", "rating", "on_sale", "version_id", "written_at"]


def test_json_rows(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"key":"user_7","fields":{"age":28,"city":"x"}}\n{"key":"user_8"}\n')
    got = {r.entity: r.fields for r in read_json_rows(spark, f"file://{tmp_path}/r.json").collect()}
    assert got["user_7"]["age"].i == 28 and got["user_7"]["city"].s == "x" and got["user_8"] == {}


def test_stream_upsert(spark, engine, tmp_path):
    log = spark.createDataFrame([(0, "a", {}, "t-v2", T0), (1, "b", {}, "t-v1", T0), (2, "a", {}, "t-v1", T0)], f"seq bigint, {ENTRIES}")
    log.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(log.schema).parquet(f"file://{tmp_path}/in")
        upsert(stream, engine, f"file://{tmp_path}/cp", "guarded").awaitTermination()
    assert {r.entity: r.version_id for r in engine.entries.collect()} == {"a": "t-v2", "b": "t-v1"}


def test_merge_and_log_through_the_engine(spark, engine):
    engine.write(rows(spark, u=fields_of(age=int_value(F.lit(52)), city=string_value(F.lit("Łódź")), level=int_value(F.lit(9)))), "v")
    engine.merge_write(rows(spark, u=fields_of(city=string_value(F.lit("Reykjavík")))), ["city"], "v")
    got = engine.read_strings(keys(spark, "u")).first().fields
    assert got == {"age": "52", "city": "Reykjavík", "level": "9"}
    engine.merge_write(rows(spark, u=fields_of(other=int_value(F.lit(1)))), ["city"], "v")
    assert engine.read_strings(keys(spark, "u")).first().fields == {"age": "52", "level": "9"}
    ops = spark.createDataFrame([(1, "delete", "u", None, None, "v", T0)], f"seq bigint, op string, entity string, fields map<string,{VALUE}>, window array<string>, version_id string, written_at timestamp_ntz")
    engine.apply_log(ops)
    assert engine.entries.count() == 0


def test_a_change_rewrites_its_buckets_only(spark, engine):
    many = spark.range(500).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity"), fields_of(x=int_value(F.col("id"))).alias("fields"))
    engine.write(many, "v")
    before = dict(engine.store.pointer["entries"])
    engine.write(rows(spark, e7=fields_of(x=int_value(F.lit(-1)))), "v")
    after = engine.store.pointer["entries"]
    assert sum(after[k] != before[k] for k in before) == 1 and len(after) == len(before) <= 64
    got = {r.entity: r.fields["x"].i for r in engine.entries.collect()}
    assert got == {f"e{i}": (-1 if i == 7 else i) for i in range(500)}
    assert engine.read(keys(spark, "e7"), few=True).first().fields["x"].i == -1
    assert len(engine.read(keys(spark, "e7"), few=True).inputFiles()) < len(engine.entries.inputFiles())
    for i in range(8):
        engine.write(rows(spark, e7=fields_of(x=int_value(F.lit(i)))), "v")
    assert engine.entries.count() == 500
    engine.delete(keys(spark, *[f"e{i}" for i in range(500)]))
    assert engine.entries.count() == 0 and engine.store.pointer["entries"] == {}


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
    assert shared_dir(spark).startswith("file://")


def test_a_failed_change_leaves_nothing_behind(spark, engine):
    v = engine.create_version("user_profile")
    engine.write(rows(spark, u=fields_of(age=int_value(F.lit(1)))), v.id)
    before = (engine.store.generation, engine.versions.state_dict(), dict(engine.batches), engine.journal_seq)
    bad = rows(spark, u=fields_of(age=int_value(F.raise_error(F.lit("broken")).cast("bigint"))))
    for change in (lambda: engine.write(bad, v.id), lambda: engine.import_rows("b", "user_profile", bad, v.id), lambda: engine.backfill("t", v.id, bad)):
        with pytest.raises(Exception, match="broken"):
            change()
    # The write of a commit itself fails: what was changed in memory before is undone.
    commit, engine.store.commit = engine.store.commit, None
    for change in (lambda: engine.publish(v.id), lambda: engine.create_version("item_profile"), lambda: engine.import_rows("b", "user_profile", rows(spark, w=fields_of(age=int_value(F.lit(2)))), v.id), lambda: engine.expand(64)):
        with pytest.raises(TypeError):
            change()
    engine.store.commit = commit
    assert (engine.store.generation, engine.versions.state_dict(), engine.batches, engine.journal_seq) == before
    assert engine.task("t") is None and engine.router.shards == 16 and engine.entries.count() == 1
    assert not [s for s in engine.store._fs.listStatus(engine.store._path(engine.store.path)) if "staged" in s.getPath().getName()]


def test_a_second_writer_is_found_out(spark, engine):
    engine.write(rows(spark, a=fields_of(x=int_value(F.lit(1)))), "v")
    other = Engine(spark, engine.store.path)
    other.write(rows(spark, b=fields_of(x=int_value(F.lit(1)))), "v")
    with pytest.raises(RuntimeError, match="another writer"):
        engine.write(rows(spark, c=fields_of(x=int_value(F.lit(1)))), "v")
    assert {r.entity for r in Engine(spark, engine.store.path).entries.collect()} == {"a", "b"}


def test_buckets_grow_and_journals_are_gathered(spark, engine):
    many = spark.range(300).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity"), fields_of(x=int_value(F.col("id"))).alias("fields"))
    engine.write(many, "v")
    for i in range(3):
        engine.import_rows(f"b{i}", "user_profile", rows(spark, e1=fields_of(age=int_value(F.lit(i)))), "v")
    held = sorted((r.journal_seq, r.batch_id) for r in engine.journal.collect())
    assert not engine.maintain() and [n for n, _ in held] == [1, 2, 3]
    assert engine.store.maintain(bucket_bytes=1000, parts=2)
    assert engine.store.pointer["buckets"] > 64 and len(engine.store.pointer["tables"]["journal"]) == 1
    assert sorted((r.journal_seq, r.batch_id) for r in engine.journal.collect()) == held
    again = Engine(spark, engine.store.path)
    assert again.entries.count() == 300 and again.get("e7") == {"x": "7"}
    again.write(rows(spark, e7=fields_of(x=int_value(F.lit(-1)))), "v")
    assert again.entries.count() == 300 and again.get("e7") == {"x": "-1"} and again.get("none") is None


def test_rows_without_an_order_have_one(spark, engine):
    both = rows(spark, u=fields_of(x=int_value(F.lit(1)))).union(rows(spark, u=fields_of(x=int_value(F.lit(2))))).select("entity", "fields")
    seen = set()
    for frame in (both, both.repartition(3), both.orderBy(F.desc(F.col("fields")["x"].i))):
        engine.write(frame, "v")
        seen.add(engine.get("u")["x"])
    assert len(seen) == 1


def test_verdicts_are_stored(spark, engine):
    log = spark.createDataFrame([(0, "a", {}, "t-v2", T0), (1, "a", {}, "t-v1", T0), (2, "a", {}, "t-v3", T0)], f"seq bigint, {ENTRIES}")
    found = engine.compare_and_write(log)
    engine.write(rows(spark, a=fields_of(x=int_value(F.lit(1)))), "t-v9")
    assert {r.seq: r.accepted for r in found.collect()} == {0: True, 1: False, 2: True}
