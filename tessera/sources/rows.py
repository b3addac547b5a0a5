"""Rows in and out: JSON requests as DataFrames, results as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import canonical, decode_fields


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(entity, fields) of JSON lines {"key": ..., "fields": {...}}; values are typed by decode_fields."""
    raw = spark.read.schema("key string, fields string").json(path)
    return raw.select(F.col("key").alias("entity"), decode_fields(F.coalesce("fields", F.lit("{}"))).alias("fields"))


def decoded(rows: DataFrame, text: str = "fields") -> DataFrame:
    """``rows`` with a JSON text column replaced by its typed fields."""
    return rows.withColumn(text, decode_fields(F.col(text)))


def exploded(entries: DataFrame) -> DataFrame:
    """(entity, field, type, s, i, f, b, canonical): one row for each field."""
    v = F.col("value")
    long = entries.select("entity", F.explode("fields").alias("field", "value"))
    return long.select("entity", "field", "value.*", canonical(v).alias("canonical"))


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def as_json(snapshots: DataFrame) -> DataFrame:
    """(json): each snapshot as an object with its fields as text, the form in which reads are served."""
    texts = F.transform_values("fields", lambda _, v: canonical(v))
    return snapshots.select(F.to_json(F.struct(F.col("entity"), F.col("version_id").alias("versionID"), texts.alias("fields"))).alias("json"))
