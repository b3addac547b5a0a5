"""The test tables as entries, write logs and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import bool_value, fields_of, float_value, int_value, string_value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _entity(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def profile(spark: SparkSession, sf_dir: str, version: str = "user_profile-v1") -> DataFrame:
    """Customers as entries of the user profile, written a minute apart from 2024-01-01 on."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    fields = fields_of(
        age=int_value(18 + F.col("c_custkey") % 60), city=string_value(F.col("n_name")), level=int_value(F.col("c_nationkey") % 5),
        active_days=int_value(F.col("c_custkey") % 365), score=float_value(F.col("c_acctbal")), is_vip=bool_value(F.col("c_acctbal") > 5000),
    )
    at = F.timestamp_add("MINUTE", F.col("c_custkey").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return c.join(F.broadcast(n), "c_nationkey").select(
        _entity("user_", "c_custkey").alias("entity"), fields.alias("fields"), F.lit(version).alias("version_id"), at.alias("written_at")
    )


def item(spark: SparkSession, sf_dir: str, version: str = "item_profile-v2") -> DataFrame:
    """Parts as entries of the item profile."""
    fields = fields_of(
        category=string_value(F.col("p_type")), price=float_value(F.col("p_retailprice")), stock=int_value(F.col("p_size")),
        rating=float_value((F.col("p_size") % 50).cast("double") / 10.0), on_sale=bool_value(F.col("p_size") < 10),
    )
    return table(spark, sf_dir, "part").select(
        _entity("item_", "p_partkey").alias("entity"), fields.alias("fields"), F.lit(version).alias("version_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("written_at"),
    )


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an ordered write log of one float field each, with versions v1 to v12."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), _entity("user_", "user_id").alias("entity"),
        F.create_map("event_type", float_value(F.col("value"))).alias("fields"),
        F.concat(F.lit("user_profile-v"), (1 + F.col("event_id") % 12).cast("string")).alias("version_id"),
        F.col("ts").cast("timestamp_ntz").alias("written_at"), F.col("event_type").alias("field"), "value",
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as backfill rows: an int counter named by the event type and a constant text."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_no"), _entity("user_", "user_id").alias("entity"),
        fields_of(active_days=int_value(F.col("event_id") % 100), tag=string_value(F.col("event_type"))).alias("fields"),
    )


# The same in SQL.
PROFILE = """profile AS (SELECT concat('user_', CAST(c_custkey AS VARCHAR)) AS entity, CAST(18 + c_custkey % 60 AS BIGINT) AS age, n_name AS city,
  CAST(c_nationkey % 5 AS BIGINT) AS level, CAST(c_custkey % 365 AS BIGINT) AS active_days, c_acctbal AS score, c_acctbal > 5000 AS is_vip,
  1704067200000000 + c_custkey * 60000000 AS us, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
ITEM = """item AS (SELECT concat('item_', CAST(p_partkey AS VARCHAR)) AS entity, p_type AS category, p_retailprice AS price,
  CAST(p_size AS BIGINT) AS stock, CAST(p_size % 50 AS DOUBLE) / 10.0 AS rating, p_size < 10 AS on_sale FROM part)"""
OPLOG = """oplog AS (SELECT event_id AS seq, concat('user_', CAST(user_id AS VARCHAR)) AS entity, event_type AS field, value,
  concat('user_profile-v', CAST(1 + event_id % 12 AS VARCHAR)) AS version_id, 1 + event_id % 12 AS rank, epoch_us(ts) AS us FROM events)"""


def hashed_sql(source: str, key: str) -> str:
    """CTEs whose last, ``hashed``, is ``source`` with h, the XXH64 of its ASCII ``key`` of under 32 characters with seed 0, step by step in 128-bit integers.

    Each step is materialised: the planner would write steps into each other.
    """
    # The five primes of XXH64.
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    big = lambda n: f"{n}::UHUGEINT"
    m = big(1 << 64)
    times = lambda x, n: f"(({x}) * {big(n)} % {m})"
    turn = lambda x, r: f"(({x}) * {big(1 << r)} % {m} + ({x}) // {big(1 << (64 - r))})"
    byte = lambda at: f"(CASE WHEN {at} < n THEN ascii(substr({key}, CAST({at} + 1 AS BIGINT), 1)) ELSE 0 END)::UHUGEINT"
    little = lambda at, size: "(" + " + ".join(f"{byte(f'({at} + {j})')} * {big(256**j)}" for j in range(size)) + ")"
    steps = [f"({big(p5)} + n::UHUGEINT)"]
    for lane in range(3):
        eight = f"({times(turn(times(little(8 * lane, 8), p2), 31), p1)})"
        steps += [f"CASE WHEN n >= {8 * lane + 8} THEN xor(h, {eight}) ELSE h END", f"CASE WHEN n >= {8 * lane + 8} THEN ({turn('h', 27)} * {big(p1)} + {big(p4)}) % {m} ELSE h END"]
    steps += [f"CASE WHEN n % 8 >= 4 THEN xor(h, {times(little('(n // 8 * 8)', 4), p1)}) ELSE h END", f"CASE WHEN n % 8 >= 4 THEN ({turn('h', 23)} * {big(p2)} + {big(p3)}) % {m} ELSE h END"]
    for i in range(3):
        steps += [f"CASE WHEN n % 4 > {i} THEN xor(h, {times(byte(f'(n // 4 * 4 + {i})'), p5)}) ELSE h END", f"CASE WHEN n % 4 > {i} THEN {times(turn('h', 11), p1)} ELSE h END"]
    for shift, prime in ((33, p2), (29, p3), (32, 1)):
        steps += [f"xor(h, h // {big(1 << shift)})", times("h", prime)]
    out = [f"hash0 AS (SELECT *, length({key}) AS n FROM {source})", f"hash1 AS MATERIALIZED (SELECT *, {steps[0]} AS h FROM hash0)"]
    out += [f"hash{i} AS MATERIALIZED (SELECT * REPLACE ({x} AS h) FROM hash{i - 1})" for i, x in enumerate(steps[1:], 2)]
    return ", ".join([*out, f"hashed AS MATERIALIZED (SELECT * FROM hash{len(steps)})"])
