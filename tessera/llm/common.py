"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir

#: Rows and bytes of text that an operator's function works on at once.
BATCH_ROWS, BATCH_BYTES = 512, 8_000_000
#: Most values that are dealt apart as hot ones, and rows that a hot one has at least.
HOT_VALUES, HOT_ROWS = 5_000, 1_000


def importable(spark: SparkSession) -> None:
    """Let Python workers of this machine import this package from where the driver has it; a cluster of several gets it by ``--py-files``."""
    if not spark.sparkContext.master.startswith("local"):
        return
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [root, held.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: int, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``rows`` rows and about ``size`` bytes of column ``text``, whatever the session's batches are; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


def scratch_root(spark: SparkSession) -> str:
    """The application's folder of intermediate tables in the shared one."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; lazy results of operators that were not read yet go with them."""
    drop(spark, scratch_root(spark))


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, one row for each ``on`` there at most, or nulls.

    Values of ``on`` that hold many rows of ``left`` meet their row by a broadcast,
    of HOT_VALUES rows at most as each holds more than that part of all rows;
    all others by a merge join. Null meets nothing and stays where it is. ``counts``:
    rows of each value, if known.
    """
    unknown = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in on])
    added = [f for f in right.schema if f.name not in on]
    alone = left.where(unknown).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    left = left.where(~unknown)
    counts = left.groupBy(*on).count() if counts is None else counts
    least = max(HOT_ROWS, (counts.agg(F.sum("count").alias("n")).first().n or 0) // HOT_VALUES)
    hot = stored(counts.where(F.col("count") > least).select(*on), "hot")
    if hot.isEmpty():
        return left.join(right.hint("merge"), on, "left").unionByName(alone)
    marked = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left")
    many = marked.where("__hot").join(F.broadcast(right.join(F.broadcast(hot), on)), on, "left")
    return many.unionByName(marked.where("__hot IS NULL").join(right.hint("merge"), on, "left")).drop("__hot").unionByName(alone)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def packed(df: DataFrame, *columns: str | Column, without: tuple[str, ...] = ()) -> DataFrame:
    """The row, but for columns ``without``, as ``_row`` beside the columns that an operator works on, so that no name of its own can clash."""
    return df.select(F.struct(*[F.col(f"`{c.replace("`", "``")}`") for c in df.columns if c not in without]).alias("_row"), *columns)


def arrow_map(
    df: DataFrame, rows: Callable[[list, list], dict], schema: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Run ``rows(keys, texts) -> columns`` over pieces of Arrow batches of (key, text); no row order or batch border matters."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            got = rows(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
