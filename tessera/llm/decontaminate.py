"""Benchmark decontamination with one Aho-Corasick automaton.

Chunks of all test items, over normalised words, become the automaton's
patterns; every text is scanned once. Hits are found in the normalised text,
extended to whole windows, and mapped back to words and to character offsets of
the original.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Words of a window.
WINDOW = 10
#: Bytes of item text in one automaton, which takes about 45 bytes of memory for each; a larger benchmark goes block by block over all texts.
BLOCK_BYTES = 8_000_000

# ASCII letters are lower-cased, other ASCII that is no digit becomes a space; all other bytes stay.
_FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else (b + 32 if 0x41 <= b <= 0x5A else 0x20)
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Normalised words; null has none."""
    return (text or "").encode().translate(_FOLD).split()


class Scanner:
    """Finds windows of items in texts by one automaton.

    Every window of ``window`` words holds one of an item's aligned chunks of half
    as many words, so that the automaton has each word of an item once instead of
    in every window; a chunk that is met is extended word by word, and only runs of
    a whole window or more are hits. An item shorter than a window is one pattern.
    Pickles as its items; a process builds the automaton once and keeps the last one.
    """

    _built: dict[str, tuple] = {}

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.items = window, defaultdict(list)
        for key, text in items:
            if ws := words(text):
                self.items[b" ".join(ws).decode("latin-1")].append(key)
        self.items = dict(self.items)
        self.digest = hashlib.sha256(repr((window, sorted((t, sorted(map(str, k))) for t, k in self.items.items()))).encode()).hexdigest()

    def automaton(self) -> tuple:
        """The automaton, each item's words, and its ids."""
        if self.digest not in self._built:
            self._built.clear()
            made, known, spelled = ahocorasick.Automaton(), [], {}
            size = (self.window + 1) // 2
            for n, text in enumerate(self.items):
                ws = [spelled.setdefault(w, w) for w in text.split(" ")]
                known.append(ws)
                step, starts = (size, range(0, len(ws) - size + 1, size)) if len(ws) >= self.window else (len(ws), [0])
                for at in starts:
                    pattern = f" {' '.join(ws[at : at + step])} "
                    if pattern in made:
                        made.get(pattern)[1].append((n, at))
                    else:
                        made.add_word(pattern, (step, [(n, at)]))
            if known:
                made.make_automaton()
            self._built[self.digest] = (made, known, [[str(k) for k in keys if k is not None] for keys in self.items.values()])
        return self._built[self.digest]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged [from, to) word spans that windows cover, and the ids of their items."""
        flat = b" ".join(words(text))
        if not flat:
            return 0, [], set()
        n = flat.count(b" ") + 1
        hits: list[tuple[int, int]] = []
        ids: set[str] = set()
        if not self.items:
            return n, hits, ids
        made, known, names = self.automaton()
        starts = own = None
        #: By item and difference of places, how far a run was followed.
        seen: dict[tuple[int, int], int] = {}
        padded = f" {flat.decode('latin-1')} "
        for end, (size, places) in made.iter(padded):
            if starts is None:
                # The k-th space of the padded text stands before word k.
                starts = np.flatnonzero(np.frombuffer(padded.encode("latin-1"), np.uint8) == 32)
                own = padded[1:-1].split(" ")
            last = int(np.searchsorted(starts, end))
            for item, at in places:
                ws, away = known[item], last - size - at
                if seen.get((item, away), -1) >= last:
                    continue
                a, b = last - size, last
                while a > max(0, away) and own[a - 1] == ws[a - 1 - away]:
                    a -= 1
                top = min(n, len(ws) + away)
                while b < top and own[b] == ws[b - away]:
                    b += 1
                seen[item, away] = b
                if b - a >= min(self.window, len(ws)):
                    hits.append((a, b))
                    ids.update(names[item])
        return n, merged(hits), ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in ``text`` of word spans."""
    if not spans:
        return []
    raw = text.encode()
    flat = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], flat.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[begin[a]]), int(chars[end[b - 1]])) for a, b in spans]


def blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of bounded size, streamed to the driver, which holds one of them at a time."""
    block: list[tuple[object, str | None]] = []
    size = 0
    for row in benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        block.append((row.k, row.t))
        size += len((row.t or "").encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scan(scanner: Scanner):
    @F.pandas_udf("n_words long, words array<struct<a:long,b:long>>, items array<string>, spans array<struct<a:long,b:long>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        found = [scanner.scan(t) for t in texts]
        pairs = lambda spans: [{"a": a, "b": b} for a, b in spans]
        return pd.DataFrame({
            "n_words": [n for n, _, _ in found],
            "words": [pairs(w) for _, w, _ in found],
            "items": [sorted(ids) for _, _, ids in found],
            "spans": [pairs(char_spans(t, w)) if w else [] for t, (_, w, _) in zip(texts, found, strict=True)],
        })

    return scan


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, items, spans, contaminated): one row for each row of ``documents``.

    ``spans`` are [start, end) character offsets of contaminated passages in the
    original text. Null and wordless texts have no words and no hits, null and
    wordless items no windows, items with a null id hit without being named; an
    empty benchmark leaves every text clean, an empty table gives no row. Very long
    texts are scanned whole, one at a time. Repeated rows are judged one by one.
    A benchmark of several blocks takes a written pass over the texts for each.
    Columns of either side other than key and text are neither read nor kept.
    """
    common.importable(documents.sparkSession)
    kind = "struct<n_words:bigint,words:array<struct<a:bigint,b:bigint>>,items:array<string>,spans:array<struct<a:bigint,b:bigint>>>"
    found = documents.select(F.col(key).alias("key"), "text", F.lit(None).cast(kind).alias("held"))
    before = False
    for block in chain(blocks(benchmark, "item_id", "text"), [[]]):
        if not block and before:
            break
        if before:
            found = common.stored(found, "contamination")
        r, held = _scan(Scanner(block, window))(F.col("text")), F.col("held")
        found = found.select("key", "text", "held", r.alias("now"))
        now = F.col("now")
        if before:
            now = F.struct(
                now.n_words.alias("n_words"), _union(F.concat(held.words, now.words)).alias("words"),
                F.array_sort(F.array_union(held.items, now["items"])).alias("items"), _union(F.concat(held.spans, now.spans)).alias("spans"),
            )
        found, before = found.select("key", "text", now.alias("held")), True
    out = found.select(F.col("key").alias(key), "held.*")
    covered = F.aggregate("words", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    return out.select(key, "n_words", covered.alias("n_hit"), "items", "spans", (F.size("words") > 0).alias("contaminated"))


def _union(spans: Column) -> Column:
    """Disjoint spans in order, of those that several blocks found in a text."""
    ordered = F.array_sort(spans)
    empty = F.filter(ordered, lambda s: F.lit(False))
    return F.aggregate(
        ordered,
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s.a <= F.element_at(acc, -1).b),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1).a.alias("a"), F.greatest(F.element_at(acc, -1).b, s.b).alias("b"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def _hit(scanner: Scanner):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(scanner.scan(t)[1]) for t in texts], dtype=bool)

    return hit


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without a benchmark passage, all columns kept; the texts are scanned in place, without a join.

    Null, empty and wordless texts stay, very long ones are scanned whole, repeated
    rows share one fate. A benchmark of several blocks takes a written pass for each.
    """
    common.importable(documents.sparkSession)
    out = documents
    for n, block in enumerate(blocks(benchmark, "item_id", "text")):
        if n:
            out = common.stored(out, "decontaminated")
        out = out.where(~_hit(Scanner(block, window))(F.col("text")))
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES = {"op3_decontaminate": op3_decontaminate}

# Window hits by joining all 10-word windows of both sides; the same rows by another road.
ORACLE = {
    "op3_decontaminate": r"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM iw, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM pat),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
win AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw, sizes, unnest(generate_series(1, len(w) - k + 1)) AS g(i) WHERE len(w) >= k),
hit AS (SELECT doc_id, win.k, i, item FROM win JOIN pat USING (k, s)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""
}
