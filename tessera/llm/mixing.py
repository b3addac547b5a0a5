"""Mixing sources to target weights by temperature.

A source's weight is its token share to a power, normalised. The power is the
largest one in [0, 1] whose weights have the wanted entropy, raised until no
source is repeated more often than allowed. Weights become whole passes over a
source and a cut through a keyed permutation of its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm import common

#: Share of the greatest entropy that the weights reach for, most passes over a source, tokens to draw by tokens there are.
ENTROPY, REPEATS, BUDGET = 0.95, 4.0, 1.0
#: Tokens of a block, and most blocks of a source.
BLOCK_TOKENS, MAX_BLOCKS = 100_000, 4096
_SEED = 6


def tokens(text: Column) -> Column:
    """White-space words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """The source as a join key that keeps null apart from every text."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source))


def _total(x: Column) -> Column:
    """Sum of doubles, the same in whatever order rows come: whole parts of 2^-24 and, of the rest, of 2^-54 are added as numbers of 64 bits."""
    scaled = x * F.lit(2.0**24)
    high = F.floor(scaled)
    low = F.rint((scaled - high) * F.lit(2.0**30)).cast("long")
    return (F.sum(high) + F.sum(low) / F.lit(2.0**30)) / F.lit(2.0**24)


def _split(low: float, high: float, n: int = 15) -> list[float]:
    return [low + (high - low) * i / (n + 1) for i in range(1, n + 1)]


def exponent(shares: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> float:
    """Bisect the power of ``shares`` (column p), fifteen cuts a pass; only sums over sources reach the driver."""
    known = shares.where("p > 0").select(F.log("p").alias("_l"))
    n = known.count()
    if n < 2:
        return 1.0

    def curve(powers: list[float]) -> list[tuple[float, float]]:
        """Entropy and most passes over a source at each power."""
        sums = []
        for a in powers:
            w = F.exp(F.lit(a) * F.col("_l"))
            sums += [_total(w), _total(w * F.col("_l")), F.max(F.exp(F.lit(a - 1.0) * F.col("_l")))]
        row = known.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        out = []
        for i, a in enumerate(powers):
            z, zl, most = row[3 * i], row[3 * i + 1], row[3 * i + 2]
            out.append((math.log(z) - a * zl / z, budget * most / z))
        return out

    def meets(point: tuple[float, float]) -> tuple[bool, bool]:
        return point[0] >= entropy * math.log(n) - 1e-12, point[1] <= repeats + 1e-12

    # Entropy falls and passes fall as the power grows: the largest power with the entropy, the smallest within the limit.
    def search(which: int) -> float:
        low, high = 0.0, 1.0
        ends = [meets(x)[which] for x in curve([0.0, 1.0])]
        if which == 0 and ends[1]:
            return 1.0
        if which == 1 and (ends[0] or not ends[1]):
            return 0.0 if ends[0] else 1.0
        for _ in range(7):
            cuts = _split(low, high)
            ok = [meets(x)[which] for x in curve(cuts)]
            points = [low, *cuts, high]
            turn = sum(ok) if which == 0 else len(ok) - sum(ok)
            low, high = points[turn], points[turn + 1]
        return low if which == 0 else high

    return max(search(0), search(1))


#: Most sources whose rows are broadcast; of more, only those that hold many rows are.
MAX_BROADCAST = 100_000


def _by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source in ``sources``, a stored table of one row for each."""
    if sources.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(sources), "_s", "left")
    return common.hot_join(rows, sources, ["_s"])


def _turn(block: Column) -> Column:
    """A keyed hash of a source's block: the permutation of its blocks."""
    return F.xxhash64("_s", block, F.lit(_SEED))


def _first_over(sums: DataFrame, order: list[str], budget: str, least: int) -> DataFrame:
    """Of each source's pieces (_s, ..., _n, budget) in ``order``, the first that does not fit what earlier ones leave, as (_s, _at, _left)."""
    before = F.sum("_n").over(Window.partitionBy("_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    left = sums.withColumn("_left", F.col(budget) - F.coalesce(before, F.lit(0)))
    at = F.struct(*order)
    over = left.where(F.col("_left") < F.greatest("_n", F.lit(least))).groupBy("_s")
    return over.agg(F.min(at).alias("_at"), F.min_by("_left", at).alias("_left"))


def plan(documents: DataFrame, **limits: float) -> DataFrame:
    """One row for each source: _s, weight, and what draws its texts.

    _k is its number of blocks; it gives _passes whole ones, and once more the blocks
    before (_turn, _b) in the permutation and, of that one, the texts up to the hash
    _last, or below _start if that is null.

    Blocks are dealt by hash, so that a source with most rows has as many blocks
    as its tokens ask for. Cumulative sums run over a source's blocks, at most
    MAX_BLOCKS, over 4,096 ranges of the hash in the one block that is cut, and over
    the texts of the one range that is cut.
    """
    budget = limits.get("budget", BUDGET)
    rows = documents.select(_key(F.col("source")).alias("_s"), _order().alias("_h"), tokens(F.col("text")).alias("_n"))
    rows = common.stored(rows, "mixing-rows")
    sources = rows.groupBy("_s").agg(F.sum("_n").alias("_t"))
    total = sources.agg(F.sum("_t").alias("n")).first().n or 0
    sources = common.stored(sources.withColumn("p", F.col("_t") / F.lit(float(max(total, 1)))), "mixing-sources")
    power = exponent(sources, **limits)
    z = sources.where("p > 0").agg(_total(F.pow("p", F.lit(power))).alias("z")).first().z or 1.0
    share = F.when(F.col("p") > 0, F.pow("p", F.lit(power)) / F.lit(z)).otherwise(0.0)
    ratio = F.when(F.col("p") > 0, F.lit(budget) * share / F.col("p")).otherwise(0.0)
    wanted = (
        sources.withColumn("weight", share)
        .withColumn("_passes", F.floor(ratio + 1e-9).cast("int"))
        .withColumn("_rest", F.round((ratio - F.col("_passes")) * F.col("_t")).cast("long"))
        .withColumn("_k", F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("_t") / BLOCK_TOKENS) + 1).cast("int"))
    )
    wanted = common.stored(wanted.select("_s", "weight", "_passes", "_rest", "_k"), "mixing-weights")
    placed = _by_source(rows, wanted.select("_s", "_k", "_rest")).withColumn("_b", F.pmod("_h", "_k"))
    sizes = placed.groupBy("_s", "_b").agg(F.sum("_n").alias("_n"), F.first("_rest").alias("_rest"))
    cut = _first_over(sizes.withColumn("_turn", _turn(F.col("_b"))), ["_turn", "_b"], "_rest", 1)
    cut = common.stored(cut.select("_s", "_at._turn", "_at._b", "_left").withColumnRenamed("_b", "_cut"), "mixing-cuts")
    inside = _by_source(placed.select("_s", "_h", "_n", "_b"), cut).where("_b = _cut AND _left > 0")
    inside = inside.select("_s", "_h", "_n", F.col("_left").alias("_rest"), F.shiftright("_h", 52).alias("_range"))
    ranges = inside.groupBy("_s", "_range").agg(F.sum("_n").alias("_n"), F.first("_rest").alias("_rest"))
    range_ = common.stored(_first_over(ranges, ["_range"], "_rest", 1).select("_s", F.col("_at._range").alias("_in"), "_left"), "mixing-ranges")
    texts = _by_source(inside.select("_s", "_h", "_n", "_range"), range_).where("_range = _in").groupBy("_s", "_h").agg(F.sum("_n").alias("_n"), F.first("_left").alias("_left"))
    run = F.sum("_n").over(Window.partitionBy("_s").orderBy("_h"))
    last = texts.withColumn("_run", run).where("_run <= _left").groupBy("_s").agg(F.max("_h").alias("_last"))
    start = F.shiftleft(F.col("_in").cast("long"), 52).alias("_start")
    made = wanted.join(cut.withColumnRenamed("_cut", "_b"), "_s", "left").join(range_.select("_s", start), "_s", "left").join(last, "_s", "left")
    return common.stored(made.select("_s", "weight", "_k", "_passes", "_turn", "_b", "_start", "_last"), "mixing-plan")


def _order() -> Column:
    """A keyed hash of the whole row's identity: the permutation of a source's texts."""
    return F.xxhash64("doc_id", "text", F.lit(_SEED + 1))


def _placed(documents: DataFrame, replaced: tuple[str, ...], **limits: float) -> DataFrame:
    """``documents`` without ``replaced`` as _row, with n_tokens, weight, copies, and the text's place: block, its turn and the text's hash."""
    own = common.packed(documents, _key(F.col("source")).alias("_s"), _order().alias("_h"), tokens(F.col("text")).alias("n_tokens"), without=replaced)
    met = _by_source(own, plan(documents.select("doc_id", "source", "text"), **limits))
    block = F.pmod("_h", "_k")
    turn = _turn(block)
    here = (turn == F.col("_turn")) & (block == F.col("_b"))
    earlier = F.col("_turn").isNull() | (turn < F.col("_turn")) | ((turn == F.col("_turn")) & (block < F.col("_b")))
    inside = here & F.coalesce(F.col("_h") <= F.col("_last"), F.col("_h") < F.col("_start"), F.lit(False))
    copies = F.col("_passes") + F.when(earlier | inside, 1).otherwise(0)
    return met.select("_row", "n_tokens", "weight", copies.cast("int").alias("copies"), block.cast("int").alias("_block"), turn.alias("_at"), "_h")


def drawn(documents: DataFrame, **limits: float) -> DataFrame:
    """``documents`` with n_tokens, weight (of its source) and copies, the times it is drawn; columns of these names are replaced, all others kept.

    Sources without a token have weight 0 and are not drawn; null is a source of
    its own. Null, empty and wordless texts have no token and share the lot of their
    place; a very long text is drawn whole or not. Rows alike in id and text share
    their lot, null ids as well. One source keeps weight 1; an empty table gives no row.
    """
    found = _placed(documents, ("n_tokens", "weight", "copies"), **limits)
    return found.select("_row.*", "n_tokens", "weight", "copies")


def scheduled(documents: DataFrame, **limits: float) -> DataFrame:
    """The drawn documents in their own columns, each as often as it is drawn, with its place in the mix.

    Sorted by pass, turn, block and place, a source's rows follow its block
    permutation; columns of these names are replaced.
    """
    found = _placed(documents, ("pass", "turn", "block", "place"), **limits).where("copies > 0")
    return found.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass"), F.col("_at").alias("turn"), F.col("_block").alias("block"), F.col("_h").alias("place")).select("_row.*", "pass", "turn", "block", "place")


def mixed(documents: DataFrame, **limits: float) -> DataFrame:
    """The drawn documents in their own columns, each as often as it is drawn; their order is no part of the result."""
    found = _placed(documents, (), **limits).where("copies > 0")
    return found.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drawn(documents).select("doc_id", "source", "n_tokens", "weight", "copies")


QUERIES = {"op6_mixing": op6_mixing}
