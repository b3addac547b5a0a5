"""Running folds over each entity's rows in order, without one task for a long entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of the log that an entity's rows are cut into.
RANGES = 256

#: A fold over a window, and of two of its results, either of which may be null.
Fold = tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]
HIGHEST: Fold = (F.max, F.greatest)
TOTAL: Fold = (F.sum, lambda a, b: F.coalesce(a + b, a, b))


def running(log: DataFrame, restart: Column, value: Column, fold: Fold, own: bool, ranges: int = RANGES) -> DataFrame:
    """``log`` (seq, entity, ...) with _run, the fold of ``value`` over an entity's rows since its last restart, and _fresh, whether none came so far.

    With ``own`` a row's run ends with its own value, else before it; a restart's
    value is the first of its run. A run without values is null.

    The log is cut into ``ranges`` of seq. Each range of an entity ends with one
    fold; what a range takes over is a running fold of those few; its own rows are a
    window by themselves, so that an entity that holds a third of the log is spread
    over many tasks.
    """
    over, both = fold
    ends = log.agg(F.struct(F.min("seq").cast("double").alias("low"), F.max("seq").cast("double").alias("high")).alias("e")).scalar()
    rows = log.withColumns({"_ends": ends, "_restart": restart, "_value": value})
    # Rounding a seq keeps the order of ranges.
    part = F.width_bucket(F.col("seq").cast("double"), F.col("_ends.low"), F.col("_ends.high"), F.lit(ranges))
    rows = rows.withColumn("_part", F.coalesce(part, F.lit(0))).drop("_ends")
    rows = rows.withColumn("_island", F.sum(F.col("_restart").cast("int")).over(W.partitionBy("entity", "_part").orderBy("seq")))
    run = W.partitionBy("entity", "_part", "_island").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_all", over(F.col("_value")).over(run))
    rows = rows.withColumn("_here", F.col("_all") if own else over(F.col("_value")).over(run.rowsBetween(W.unboundedPreceding, -1)))
    last = rows.groupBy("entity", "_part").agg(F.max_by(F.struct("_island", "_all"), "seq").alias("_l"))
    order = W.partitionBy("entity").orderBy("_part")
    last = last.select("entity", "_part", "_l._all", F.sum((F.col("_l._island") > 0).cast("int")).over(order).alias("_since"))
    so_far = over(F.col("_all")).over(W.partitionBy("entity", "_since").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = last.withColumn("_far", so_far)
    taken = last.select("entity", "_part", F.lag("_far").over(order).alias("_before"), (F.coalesce(F.lag("_since").over(order), F.lit(0)) == 0).alias("_none"))
    met = rows.join(taken.hint("merge"), ["entity", "_part"])
    first = F.col("_island") == 0
    met = met.withColumn("_run", F.when(first, both(F.col("_before"), F.col("_here"))).otherwise(F.col("_here")))
    return met.withColumn("_fresh", first & F.col("_none")).drop("_part", "_island", "_all", "_here", "_before", "_none", "_restart", "_value")
