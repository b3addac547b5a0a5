"""Comparison of the online view with an offline one over contiguous time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.times import micros
from tessera.functions.values import FIELDS, canonical, no_fields
from tessera.operators.reads import projected
from tessera.operators.versions import Manager, Version, switch_windows

DEFAULT_STEP = timedelta(hours=1)
#: Windows that are broadcast at most; more are joined by their time buckets. Buckets of a comparison, at least.
MAX_BROADCAST, BUCKETS = 100_000, 4096


def partition(spark: SparkSession, begin: datetime, until: datetime, step: timedelta) -> DataFrame:
    """(window, begin, end): windows of ``step`` from ``begin`` on, the last one cut at ``until``."""
    if step <= timedelta(0):
        raise ValueError("step must be positive")
    n = -(-(until - begin) // step) if until > begin else 0
    micros = step // timedelta(microseconds=1)
    start = F.lit(begin).cast("timestamp_ntz")
    at = lambda i: start + F.make_dt_interval(secs=(i * F.lit(micros)).cast("decimal(18,0)") / 1_000_000)
    rows = spark.range(n).select(F.col("id").cast("int").alias("window"), at(F.col("id")).alias("begin"), at(F.col("id") + 1).alias("end"))
    return rows.withColumn("end", F.least("end", F.lit(until).cast("timestamp_ntz")))


def windows(spark: SparkSession, manager: Manager, begin: datetime, until: datetime, step: timedelta = DEFAULT_STEP) -> DataFrame:
    """Windows bounded by version switches; where nothing was switched, by steps."""
    if until <= begin:
        raise ValueError("the range is empty")
    events = manager.switch_events(begin, until)
    if len(events) == 1:
        return partition(spark, begin, until, step if step > timedelta(0) else DEFAULT_STEP)
    return switch_windows(spark.createDataFrame(events, "version_id string, at timestamp_ntz"), begin)


def placed(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """Entries written in a window, with its number.

    Windows are cut into equal time buckets, so that an entry looks up its own
    bucket instead of every window.
    """
    edge = spans.agg(F.count("*").alias("n"), micros(F.min("begin")).alias("b"), micros(F.max("end")).alias("e")).first()
    low, width = edge.b or 0, max(1, -(-((edge.e or 1) - (edge.b or 0)) // max(BUCKETS, edge.n)))
    bucket = lambda t: F.floor((micros(t) - F.lit(low)) / F.lit(width)).cast("int")
    cut = spans.select("window", F.col("begin").alias("_b"), F.col("end").alias("_e"))
    cut = cut.where("_e > _b").withColumn("_k", F.explode(F.sequence(bucket(F.col("_b")), bucket(F.col("_e")))))
    inside = (F.col("written_at") >= F.col("_b")) & (F.col("written_at") < F.col("_e"))
    # About as many rows as windows and buckets.
    cut = F.broadcast(cut) if edge.n <= MAX_BROADCAST else cut.hint("merge")
    met = entries.withColumn("_k", bucket(F.col("written_at"))).join(cut, "_k")
    return met.where(inside).drop("_k", "_b", "_e")


def check(entries: DataFrame, offline: DataFrame, spans: DataFrame, version: Version | None, both: bool = False) -> DataFrame:
    """(entity, field, window, online, offline) of fields whose canonical texts differ.

    A field or entity that is not offline compares as the empty text. Fields that
    are only offline count with ``both``. Only the version's fields are compared.
    """
    names = version.fields if version is not None and version.fields else None
    online = placed(projected(entries, names), spans).select("entity", "window", "fields")
    other = projected(offline, names).select("entity", F.col("fields").alias("_other"))
    # Whole maps meet once for an entity; only what differs becomes rows.
    met = online.join(other, "entity", "left")
    theirs = F.coalesce("_other", no_fields())
    keys = F.map_keys("fields")
    keys = F.array_union(keys, F.map_keys(theirs)) if both else keys
    text = lambda held, k: F.coalesce(canonical(held[k]), F.lit(""))
    pairs = F.transform(keys, lambda k: F.struct(k.alias("field"), text(F.col("fields"), k).alias("online"), text(theirs, k).alias("offline")))
    differing = F.filter(pairs, lambda p: p.online != p.offline)
    return met.select("entity", "window", F.inline(differing)).select("entity", "field", "window", "online", "offline")


def offline_view(entries: DataFrame, view: Callable[[str], dict | None]) -> DataFrame:
    """The offline view (entity, fields) of the entries' keys that a function gives key by key: a dict of plain values, or None for an entity that is not there.

    For views that are no table; the function runs in Python workers, a batch of keys at a time.
    """

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"entity string, fields {FIELDS}"))

    def one(x: object) -> dict:
        kind, slot = ("bool", "b") if isinstance(x, bool) else ("int", "i") if isinstance(x, int) else ("float", "f") if isinstance(x, float) else ("string", "s")
        return {"type": kind, "s": None, "i": None, "f": None, "b": None, slot: x}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, v) for k in batch.column(0).to_pylist() if (v := view(k)) is not None]
            columns = [[k for k, _ in found], [[(n, one(x)) for n, x in v.items() if x is not None] for _, v in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return entries.select("entity").mapInArrow(run, f"entity string, fields {FIELDS}")
