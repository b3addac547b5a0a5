"""Quality rules as a learned decision list.

Text statistics are built-in expressions. Sequential covering then grows
threshold conjunctions for rejection from counts of labelled rows by discretised
statistics, prunes them on held-back rows, and emits the list as one ordered
conditional expression: the first rule that fits decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Bound of the labelled sample, and cut points of a statistic.
SAMPLE_ROWS, CUTS = 20_000, 12
#: Rules in a list, conditions in a rule, sample rows that a rule must reject at least.
MAX_RULES, MAX_CONDITIONS, LEAST_ROWS = 12, 3, 15
#: A rule is kept if at least this share of the rows it rejects is labelled bad, growing and pruning rows apart.
LEAST_PRECISION = 0.9

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column, size: int = 8) -> Column:
    """Words covered by windows of 8 that occur twice or more in the array of words."""
    step = lambda h, d: F.transform(F.slice(h, 1, F.size(h) - d), lambda x, i: F.xxhash64(x, F.get(h, i + d)))

    def covered(windows: Column) -> Column:
        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def of_sorted(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a).h == F.get(s, b).h, F.lit(False))
            twice = F.filter(s, lambda x, i: ((i > 0) & same(i - 1, i)) | same(i, i + 1))
            at = F.array_sort(F.transform(twice, lambda x: x.i))
            return _let(
                at,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))),
                    F.lit(0).cast("long"),
                    lambda n, x: n + x,
                ),
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            _let(F.array_sort(pairs), of_sorted)
        )

    of_words = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h1: _let(step(h1, 1), lambda h2: _let(step(h2, 2), lambda h4: _let(step(h4, 4), covered))),
    )
    return F.when(F.size(words) <= size, F.lit(0).cast("long")).otherwise(of_words)


#: Counts that the base rules and the result have, and more of them for learned rules.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SHAPE = ["n_upper", "n_ends", "n_digits", "n_distinct"]


def statistics(documents: DataFrame) -> DataFrame:
    """``documents`` with the statistics of column text added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null text has none of each, a very long one is counted whole. Repeated rows
    are counted one by one; an empty table gives no row. Columns with the names of
    statistics are replaced, all others kept.
    """
    return _counted(common.packed(documents, "text", without=(*COUNTS,))).select("_row.*", *COUNTS)


def _counted(packed: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.regexp_replace(t, _SPACE, " ")
    words = F.filter(F.split(spaced, " ", -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.regexp_replace(x, _SPACE, "")) > 0)
    return (
        packed.withColumn("_words", words)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(t).cast("long") - F.length(F.regexp_replace(t, r"[^\x20\x09-\x0D]+", "")))
        .withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", _repeated(F.col("_words")))
        .drop("_words")
    )


#: Statistics that rules may test, as SQL over the counts.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "ends": "n_ends / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}


def _shape(packed: DataFrame) -> DataFrame:
    """More counts for rules: capitals, sentence ends, digits and distinct words."""
    t = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    return (
        packed.withColumn("n_upper", count(r"\P{Lu}+"))
        .withColumn("n_ends", count(r"[^.!?]+"))
        .withColumn("n_digits", count(r"[^0-9]+"))
        .withColumn("n_distinct", F.size(F.array_distinct(F.split(t, r"[\x20\x09-\x0D]+", -1))).cast("long"))
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.cut!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    rejects: int
    wrong: int

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


#: A row of labelled statistics: bins by feature, counts of good and bad rows to grow on and to prune on.
Cell = tuple[tuple[int, ...], tuple[int, int], tuple[int, int]]


def _fits(cell: Cell, tests: list[tuple[int, bool, int]]) -> bool:
    return all((cell[0][f] > b) == above for f, above, b in tests)


def _counts(cells: list[Cell], tests: list, part: int) -> tuple[int, int]:
    fit = [c[part] for c in cells if _fits(c, tests)]
    return sum(g for g, _ in fit), sum(b for _, b in fit)


def cover(cells: list[Cell], features: list[str], cuts: list[list[float]]) -> list[Rule]:
    """Sequential covering: grow a rule by information gain, prune it on the other rows, remove what it covers, go on."""
    rules: list[Rule] = []
    literals = [(f, above, b) for f in range(len(features)) for b in range(len(cuts[f])) for above in (True, False)]
    rest = cells
    while len(rules) < MAX_RULES:
        tests: list[tuple[int, bool, int]] = []
        good, bad = _counts(rest, [], 1)
        while bad and good and len(tests) < MAX_CONDITIONS:
            base, best = math.log2(bad / (good + bad)), None
            inside = [c for c in rest if _fits(c, tests)]
            for literal in literals:
                g, b = _counts(inside, [literal], 1)
                if b >= LEAST_ROWS and (gain := b * (math.log2(b / (g + b)) - base)) > 1e-9 and (not best or gain > best[0]):
                    best = (gain, literal, g, b)
            if not best:
                break
            tests.append(best[1])
            good, bad = best[2:]
        # Prune: drop trailing conditions while the rule is worth no less on the rows that it was not grown on.
        worth = lambda ts: (lambda g, b: (b - g) / max(1, g + b))(*_counts(rest, ts, 2))
        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        both = [_counts(rest, tests, part) for part in (1, 2)]
        g, b = sum(x[0] for x in both), sum(x[1] for x in both)
        if not tests or any(y < LEAST_PRECISION * (x + y) for x, y in both) or b < LEAST_ROWS:
            break
        rules.append(Rule(tuple(Condition(features[f], above, cuts[f][i]) for f, above, i in tests), b, g))
        rest = [c for c in rest if not _fits(c, tests)]
    return rules


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> list[Rule]:
    """A decision list from labelled rows of ``documents``, at most about SAMPLE_ROWS of them."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("_y"))
    n = known.count()
    if n > SAMPLE_ROWS:
        known = known.where(F.pmod(F.xxhash64(key, F.lit(2)), F.lit(1_000_003)) < int(1_000_003 * SAMPLE_ROWS / n))
    # The sample's bound is that of the broadcast, so that no text is shuffled.
    measured = _shape(_counted(documents.select(key, "text").join(F.broadcast(known), key)))
    features = list(FEATURES)
    rows = measured.select(
        "_y", (F.pmod(F.xxhash64(key, F.lit(3)), F.lit(3)) == 0).alias("_prune"), *[F.expr(FEATURES[f]).cast("double").alias(f) for f in features]
    )
    rows = common.stored(rows, "quality-sample")
    quantiles = [i / (CUTS + 1) for i in range(1, CUTS + 1)] + [0.97, 0.99]
    # Exact ones of a bounded sample: the same list in every run.
    found = rows.agg(*[F.percentile(f, [*quantiles]).alias(f) for f in features]).first()
    cuts = [sorted(set(found[f] or [])) for f in features]
    bins = [
        sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cs), F.lit(0)).alias(f)
        for f, cs in zip(features, cuts, strict=True)
    ]
    count = lambda y, prune: F.count_if((F.col("_y") == y) & (F.col("_prune") == prune))
    table = (
        rows.select("_y", "_prune", *bins)
        .groupBy(*features)
        .agg(*[count(y, p).alias(f"_{y}{int(p)}") for p in (False, True) for y in (1, 0)])
        .collect()
    )
    # A feature's bin is the number of cuts below it, so "above cut i" is "bin > i".
    cells = sorted((tuple(r[f] for f in features), (r["_10"], r["_00"]), (r["_11"], r["_01"])) for r in table)
    return cover(cells, features, cuts)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that fits, from 1; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(F.expr(rule.sql()), i) if out is None else out.when(F.expr(rule.sql()), i)
    return F.lit(None).cast("int") if out is None else out


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _judged(documents: DataFrame, labels: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    rules = learn(documents, labels)
    return (
        _shape(_counted(common.packed(documents, "text", without=without)))
        .withColumn("base_failed", _base_failed())
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


_RESULT = (*COUNTS, *_SHAPE, "base_failed", "rule", "kept")


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` with the statistics, base_failed, the number of the rejecting rule and kept.

    Null and empty texts have no words and fail the base; very long texts are
    counted whole. Without labels, or with labels of one class, the list is empty
    and the base alone decides. Repeated rows are judged one by one; labels of one
    key that differ count as bad; of rules of equal gain the one with the first
    feature and cut is grown, and the first rule of the list that fits is named. An
    empty table gives no row. Columns with the names of results are replaced, all
    others kept.
    """
    return _judged(documents, labels, _RESULT).select("_row.*", *_RESULT)


def keep(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base nor the list rejects, in their own columns."""
    return _judged(documents, labels).where("kept").select("_row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(documents, common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "rule")


QUERIES = {"op2_quality": op2_quality}
