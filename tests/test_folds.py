"""The folds against sequential models of the same logs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.values import ENTRIES, VALUE
from tessera.operators import backfill, ingest, ttl, writes
from tessera.operators.running import HIGHEST, TOTAL, running

T0 = datetime(2024, 1, 1)
LOG = f"seq bigint, op string, entity string, fields map<string,{VALUE}>, window array<string>, version_id string, written_at timestamp_ntz"
ROWS = f"row_no bigint, entity string, fields map<string,{VALUE}>"


def val(x):
    return ("int", None, x, None, None)


def fields(frame):
    return {r.entity: ({k: v.i for k, v in r.fields.items()}, r.version_id) for r in frame.collect()}


def entries(spark, state):
    return spark.createDataFrame([(k, {n: val(x) for n, x in f.items()}, v, T0) for k, (f, v) in state.items()], ENTRIES)


def random_log(rng, n, ops):
    log = []
    for i in range(n):
        op = rng.choice(ops)
        window = rng.sample("abc", rng.randint(0, 3)) if op == "merge" else None
        names = rng.sample("abcd", rng.randint(0, 3))
        log.append((i, op, f"e{rng.randint(0, 7)}", {k: val(rng.randint(0, 9)) for k in names}, window, f"t-v{rng.randint(1, 12)}", T0 + timedelta(seconds=i)))
    rng.shuffle(log)
    return log


def rank(v):
    digits = v.rsplit("v", 1)[-1]
    return int(digits) if digits.isdigit() else 0


@pytest.mark.parametrize("seed", range(3))
def test_mixed_log(spark, seed):
    rng = random.Random(seed)
    state = {f"e{i}": ({"a": i, "z": 1}, "t-v1") for i in range(4)}
    start = entries(spark, state)
    log = random_log(rng, 120, ["write", "merge", "merge", "delete"])
    for _, op, e, f, window, v, _ in sorted(log, key=lambda r: r[0]):
        if op == "delete":
            state.pop(e, None)
        elif op == "write":
            state[e] = ({k: x[2] for k, x in f.items()}, v)
        else:
            old = {k: x for k, x in state.get(e, ({}, ""))[0].items() if k not in window}
            state[e] = (old | {k: x[2] for k, x in f.items() if k in window}, v)
    assert fields(writes.apply_log(start, spark.createDataFrame(log, LOG))) == state


@pytest.mark.parametrize("seed", range(3))
def test_guarded_log(spark, seed):
    rng = random.Random(seed)
    state = {f"e{i}": ({"a": i}, f"t-v{rng.randint(1, 12)}") for i in range(4)}
    start = entries(spark, state)
    log = random_log(rng, 150, ["write"])
    accepted = {}
    for i, _, e, f, _, v, _ in sorted(log, key=lambda r: r[0]):
        held = state.get(e, ({}, ""))[1]
        accepted[i] = not (held and rank(held) > rank(v))
        if accepted[i]:
            state[e] = ({k: x[2] for k, x in f.items()}, v)
    frame = spark.createDataFrame(log, LOG)
    assert {r.seq: r.accepted for r in writes.guarded(frame, start).collect()} == accepted
    assert fields(writes.compare_and_write(start, frame)) == state


@pytest.mark.parametrize("ranges", [1, 2, 7, 256])
def test_running_folds(spark, ranges):
    """Runs, restarts and ranges of all lengths; seq with gaps, nulls among values."""
    rng = random.Random(ranges)
    log = [(i * i % 7919 + i * 3 - 500, f"e{int(rng.random() ** 3 * 4)}", rng.choice([None, *range(20)]), rng.random() < 0.1) for i in range(400)]
    log = [(seq, *rest) for seq, *rest in {r[0]: r for r in log}.values()]
    frame = spark.createDataFrame(log, "seq bigint, entity string, v bigint, again boolean")
    for fold, plain in ((HIGHEST, max), (TOTAL, sum)):
        for own in (True, False):
            wanted, held, fresh = {}, {}, {}
            for seq, e, v, again in sorted(log):
                if again:
                    held[e], fresh[e] = [], False
                inside = held.setdefault(e, [])
                before = list(inside)
                if v is not None:
                    inside.append(v)
                run = inside if own else before
                wanted[seq] = (plain(run) if run else None, fresh.get(e, True))
            got = running(frame, F.col("again"), F.col("v"), fold, own, ranges).collect()
            assert {r.seq: (r._run, r._fresh) for r in got} == wanted and len(got) == len(log)
    assert running(frame.where("false"), F.col("again"), F.col("v"), TOTAL, True).count() == 0


def test_guarded_log_with_unguarded_writes(spark):
    rng = random.Random(9)
    log = [(i, f"e{rng.randint(0, 3)}", f"t-v{rng.randint(1, 12)}", rng.random() < 0.2) for i in range(200)]
    held, accepted = {}, {}
    for i, e, v, free in log:
        accepted[i] = free or rank(v) >= held.get(e, 0)
        if accepted[i]:
            held[e] = rank(v)
    frame = spark.createDataFrame(log, "seq bigint, entity string, version_id string, unguarded boolean")
    assert {r.seq: r.accepted for r in writes.guarded(frame).collect()} == accepted


def test_guard_rejects_an_older_version(spark):
    start = entries(spark, {"u": ({"score": 71}, "t-v2")})
    log = spark.createDataFrame([(0, "write", "u", {"score": val(3)}, None, "t-v1", T0)], LOG)
    assert fields(writes.compare_and_write(start, log)) == {"u": ({"score": 71}, "t-v2")}
    newer = spark.createDataFrame([(0, "write", "u", {"score": val(3)}, None, "t-v10", T0)], LOG)
    assert fields(writes.compare_and_write(start, newer)) == {"u": ({"score": 3}, "t-v10")}
    # Read backwards, ten is one.
    assert fields(writes.compare_and_write(start, newer, compat=True)) == {"u": ({"score": 71}, "t-v2")}


@pytest.mark.parametrize("seed", range(3))
def test_import_and_rollback(spark, seed):
    rng = random.Random(seed)
    state = {f"e{i}": ({"a": i, "q": 7}, "t-v1") for i in range(4)}
    start = entries(spark, state)
    rows = [(i, f"e{rng.randint(0, 7)}", {k: val(rng.randint(0, 9)) for k in rng.sample("abx", rng.randint(0, 3))}) for i in range(60)]
    frame, window = spark.createDataFrame(rows, ROWS), ["a", "b"]
    after = dict(state)
    for _, e, f in rows:
        old = {k: x for k, x in after.get(e, ({}, ""))[0].items() if k not in window}
        after[e] = (old | {k: x[2] for k, x in f.items() if k in window}, "t-v2")
    made = ingest.import_batch(start, frame, window, "t-v2", T0)
    assert fields(made) == after
    journal = ingest.journal_of(start, frame, "b", 0, 8)
    assert fields(ingest.rollback(made, journal, "b")) == state
    assert fields(ingest.rollback(made, journal, "other")) == after
    assert sum(r.rows for r in ingest.segments(frame, 8).collect()) == 60


def test_backfill_run_and_retry(spark):
    start = entries(spark, {"user_1": ({"cnt": 5, "gone": 1}, "t-v1"), "user_3": ({"cnt": 1}, "t-v9")})
    rows = spark.createDataFrame([(0, "user_2", {"cnt": val(20)}), (1, "user_1", {"cnt": val(10)}), (2, "user_1", {"cnt": val(99)}), (3, "user_3", {"cnt": val(1)})], ROWS)
    after, decided = backfill.run(start, rows, "t-v2", T0)
    assert fields(after) == {"user_1": ({"cnt": 15}, "t-v2"), "user_2": ({"cnt": 20}, "t-v2"), "user_3": ({"cnt": 1}, "t-v9")}
    assert {r.entity: r.accepted for r in decided.collect()} == {"user_1": True, "user_2": True, "user_3": False}
    none = spark.createDataFrame([], backfill.COMMITTED)
    once, marks, _ = backfill.retry(start, rows, none, "t", "t-v2", T0)
    again, _, left = backfill.retry(once, rows, marks, "t", "t-v2", T0)
    assert fields(once) == fields(after) == fields(again)
    assert [r.entity for r in left.collect()] == ["user_3"]
    assert [r.entity for r in backfill.plan_keys(rows).collect()] == ["user_1", "user_1", "user_2", "user_3"]


def test_literal_backfill_compounds(spark):
    start = entries(spark, {"u": ({"cnt": 3}, "t-v1")})
    rows = spark.createDataFrame([(i, "u", {"cnt": val(2)}) for i in range(3)], ROWS)
    after, _ = backfill.run(start, rows, "t-v2", T0, compat=True)
    assert fields(after) == {"u": ({"cnt": (3 + 2) * 4}, "t-v2")}


def test_signature(spark):
    rows = spark.createDataFrame([(0, "e", {"cnt": val(7)})], ROWS)
    assert backfill.signature("task-s", rows) == "task-s#4"
    assert backfill.signature("t", rows.where("false")) == "t#0"


def test_overflow_is_an_error(spark):
    start = entries(spark, {"u": ({"cnt": 2**63 - 1}, "t-v1")})
    after, _ = backfill.run(start, spark.createDataFrame([(0, "u", {"cnt": val(1)})], ROWS), "t-v2", T0)
    with pytest.raises(Exception, match="OVERFLOW"):
        after.collect()


def test_expiry_is_strict(spark):
    now, limit = T0 + timedelta(hours=1), timedelta(seconds=60)
    rows = [(k, {}, "v", now - timedelta(seconds=s)) for k, s in (("old", 120), ("edge", 60), ("new", 10))]
    frame = spark.createDataFrame(rows, ENTRIES)
    assert [r.entity for r in ttl.expired(frame, now, limit).collect()] == ["old"]
    assert {r.entity for r in ttl.survivors(frame, now, limit).collect()} == {"edge", "new"}
    assert ttl.is_expired(timedelta(hours=25), timedelta(0)) and not ttl.is_expired(timedelta(hours=24), timedelta(0))


def test_delete_is_idempotent(spark):
    start = entries(spark, {"a": ({}, "v"), "b": ({}, "v")})
    keys = spark.createDataFrame([("a",), ("a",), ("zz",)], "entity string")
    assert [r.entity for r in writes.delete(start, keys).collect()] == ["b"]
    assert start.count() == 2 and start.where(F.col("entity") == "a").count() == 1


def test_literal_backfill_compounds_without_a_cap(spark):
    from collections import Counter

    from tessera.plans import adapters, catalogue

    d = "/root/testdata/sf0.1"
    held = {r.entity: r.p for r in adapters.profile(spark, d).selectExpr("entity", "fields['active_days'].i AS p").collect()}
    rows = adapters.counters(spark, d).selectExpr("row_no", "entity", "fields['active_days'].i AS x").collect()
    copies, first = Counter(r.entity for r in rows), {}
    for r in sorted(rows, key=lambda r: r.row_no):
        first.setdefault(r.entity, r.x)
    wanted = {}
    for e, x in first.items():
        value, row = held.get(e) or 0, x
        for _ in range(copies[e]):
            # The row's map is changed in place: the next copy adds what this one came to.
            value = row = (value + row + 2**63) % 2**64 - 2**63
        wanted[e] = value
    got = {r.entity: r.total for r in catalogue.QUERIES["backfill_compound_all"](spark, d).collect()}
    assert got == wanted and max(copies.values()) > 65 and any(v < 0 for v in wanted.values())
