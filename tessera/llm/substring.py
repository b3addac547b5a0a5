"""Removal of repeated byte strings with sparse suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it starts anywhere
else too. Only some suffixes are sorted: in every string of LENGTH bytes the
leftmost smallest hash of its grams names an anchor, and equal strings have equal
anchors at the same place. So each anchor speaks for a run of string starts, its
context is the text that those strings span, and strings can only be equal if
their anchors' grams are.

1. Each text gives its anchors: gram hash (class), context digest, run of starts.
2. Anchors meet by class. A context that occurs twice is repeated whole. Classes
   with several contexts send one of each on.
3. Those contexts' texts are fetched, and the suffixes from the anchors, and the
   prefixes to them read backwards, are sorted deep-shallow. For each offset,
   strings are equal if they share a run of the common-prefix arrays on both sides.
4. Spans of repeated strings are united by document and cut out.

Nothing but rows of numbers and the contexts of repeated classes is shuffled
besides the texts themselves. Frequent classes meet dealt by context, frequent
contexts, known to be repeated, by text; classes of more contexts than a task
should sort are resolved by digests of their strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm import common
from tessera.llm.suffix_sort import deep_shallow

LENGTH, GRAM = 200, 64
#: Bytes that are hashed at once, and bytes of contexts that are sorted at once.
SCAN_BYTES, SORT_BYTES = 1 << 20, 4 << 20
#: Share of sampled anchors from which a class counts as frequent, its least count in the sample, and the sample: one text in so many.
HOT_SHARE, HOT_ROWS, HOT_SAMPLE, SALTS = 0.0005, 1000, 64, 256
#: Contexts of a class that are sorted in one task.
CLASS_SIZE = 20_000

_STEPS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_BYTES = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 64 bytes from each position on, by doubling; the last 63 positions have none."""
    h = _BYTES[data]
    size = 1
    for step in _STEPS:
        h = h[:-size] * np.uint64(step) + h[size:]
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Anchors of all strings of LENGTH bytes within each text.

    doc: number of the text; lo, span: the strings that start at lo to lo + span
    have the anchor; off: its place after lo; cls: hash of its gram; c1, c2:
    digest of the context, the bytes lo to lo + span + LENGTH.
    """
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "lo", "span", "off", "cls", "c1", "c2")}
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        data = b"".join(t for _, _, t in group)
        lengths = np.array([len(t) for _, _, t in group])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        h = _gram_hashes(np.frombuffer(data, np.uint8))
        low = _window_minimum((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Strings that would cross the end of a text are none.
        edge = np.zeros(len(at) + 1, np.int8)
        for s, e in zip(starts, ends, strict=True):
            if e - s >= LENGTH:
                edge[s] += 1
                edge[e - LENGTH + 1] -= 1
        valid = np.flatnonzero(np.cumsum(edge[:-1]))
        if not len(valid):
            return
        anchor = at[valid]
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(valid)])) - 1
        lo, hi, anchor = valid[first], valid[last], anchor[first]
        view = memoryview(data)
        digest = b"".join(
            [xxhash.xxh3_128_digest(view[a : b + LENGTH]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        )
        pair = np.frombuffer(digest, "<i8").reshape(-1, 2)
        doc = np.searchsorted(ends, lo, side="right")
        number = np.array([n for n, _, _ in group])[doc]
        skipped = np.array([k for _, k, _ in group])[doc]
        found = {
            "doc": number, "lo": lo - starts[doc] + skipped, "span": hi - lo, "off": anchor - lo,
            "cls": h[anchor].view(np.int64), "c1": pair[:, 0], "c2": pair[:, 1],
        }
        for k, v in found.items():
            out[k].append(v)

    for n, text in enumerate(texts):
        # Long texts come in parts whose strings' starts follow on each other.
        for k in range(0, max(1, len(text) - LENGTH + 1), SCAN_BYTES):
            part = text[k : k + SCAN_BYTES + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            group.append((n, k, part))
            size += len(part)
            if size >= SCAN_BYTES:
                flush()
                group, size = [], 0
    if group:
        flush()
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


_ANCHOR = "id long, lo int, span short, off short, cls long, c1 long, c2 long"
_CONTEXT = "id long, lo int, span short, off short, cls long, large boolean, twice boolean, text binary"


_TYPES = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) for f in schema], schema=schema)


def _anchor_rows(documents: DataFrame) -> DataFrame:
    schema = _arrow(_ANCHOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 1):
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            found = anchors([(t or "").encode() for t in batch.column(1).to_pylist()])
            if len(found["doc"]):
                yield _batch(schema, found | {"id": ids[found.pop("doc")]})

    return documents.select("id", "text").mapInArrow(run, _ANCHOR)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by class and context: those whose context comes again, and one of each context of mixed classes.

    Only the last row of a batch waits for the next one, and the first row of a class until a second context shows.
    """
    names = ("id", "lo", "span", "off", "cls", "salt", "c1", "c2")
    schema = _arrow("id long, lo int, span short, off short, cls long, salt int, twice boolean, wanted boolean")
    held: dict[str, np.ndarray] | None = None  # the last row, undecided
    held_same = False  # whether its context is that of the row before it
    held_mixed = False  # whether another context of its class came before
    first: dict[str, np.ndarray] | None = None  # of a class of one context so far: its first row, decided but for "wanted"

    def decide(rows: dict[str, np.ndarray], final: bool) -> dict | None:
        nonlocal held, held_same, held_mixed, first
        n = len(rows["id"])
        cls = np.ones(n, bool)
        cls[1:] = (rows["cls"][1:] != rows["cls"][:-1]) | (rows["salt"][1:] != rows["salt"][:-1])
        ctx = cls.copy()
        ctx[1:] |= (rows["c1"][1:] != rows["c1"][:-1]) | (rows["c2"][1:] != rows["c2"][:-1])
        same = ~ctx
        same[0] = held_same
        begins = ~same  # first row of its context
        m = n if final else n - 1
        nxt = np.zeros(n, bool)
        nxt[:-1] = ~ctx[1:]
        twice = same | nxt
        # A class is mixed if a context begins in it after its first row.
        where = np.cumsum(cls) - 1
        later = np.zeros(where[-1] + 1, bool)
        later[where[begins & ~cls]] = True
        if held_mixed:
            later[0] = True
        carried = first is not None and held is not None and rows["salt"][0] == 0
        # The contexts of a class that is dealt out by salt may be mixed without showing it here.
        wanted = begins & (later[where] | (rows["salt"] > 0)) & (rows["salt"] >= 0)
        # Contexts that are known to be repeated.
        twice |= (rows["salt"] < 0) | (rows["salt"] > SALTS)
        out = {k: rows[k][:m] for k in ("id", "lo", "span", "off", "cls", "salt")} | {"twice": twice[:m], "wanted": wanted[:m]}
        keep = out["twice"] | out["wanted"]
        out = {k: v[keep] for k, v in out.items()}
        if carried and later[0] and not held_mixed:
            # The class's first row went before; its twin goes now, as the context's one.
            out = {k: np.concatenate((first[k], v)) for k, v in out.items()}
        if not final:
            start = int(np.flatnonzero(cls)[-1])
            if start > 0 or not carried:
                # The open class began here (or is the first): remember its first row unless it waits itself.
                first = None
                if start < m and rows["salt"][start] == 0:
                    first = {k: rows[k][start : start + 1] for k in ("id", "lo", "span", "off", "cls", "salt")}
                    first |= {"twice": np.array([bool(twice[start])]), "wanted": np.array([True])}
            held_mixed = bool(later[where[-1]])
            if held_mixed:
                first = None
            held_same = bool(same[-1])
            held = {k: v[-1:] for k, v in rows.items()}
        return out if len(out["id"]) else None

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
        if held is not None:
            rows = {k: np.concatenate((held[k], v)) for k, v in rows.items()}
        if (out := decide(rows, False)) is not None:
            yield _batch(schema, out)
    if held is not None and (out := decide(held, True)) is not None:
        yield _batch(schema, out)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_CONTEXT)
    columns: dict[str, list] = {f.name: [] for f in schema}
    size = 0
    for batch in common.pieces(batches, 1):
        for key, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = (text or "").encode()
            for r in found:
                for k in ("lo", "span", "off", "cls", "large", "twice"):
                    columns[k].append(r[k])
                columns["id"].append(key)
                columns["text"].append(data[r["lo"] : r["lo"] + r["span"] + LENGTH])
                size += r["span"] + LENGTH
                # Contexts overlap, so that a text's may be many times its size.
                if size >= common.BATCH_BYTES:
                    yield _batch(schema, columns)
                    columns, size = {f.name: [] for f in schema}, 0
    if size:
        yield _batch(schema, columns)


def repeated_starts(rows: list[tuple[int, int, int, bool, bytes]]) -> list[tuple[int, int]]:
    """(row, start) of strings that another row has at the same offset from its anchor.

    A row is (lo, span, off, known, context); rows known to be repeated only serve
    as partners. Rows of different classes may be mixed: their anchors' grams differ.
    """
    lo, span, off = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    known = np.array([r[3] for r in rows], bool)
    right_order, right_shared = deep_shallow([r[4][r[2] :] for r in rows])
    left_order, left_shared = deep_shallow([r[4][: r[2]][::-1] for r in rows])
    found: list[np.ndarray] = []
    least = off - span
    for o in range(int(least.min(initial=0)), int(off.max(initial=-1)) + 1):
        here = (least <= o) & (o <= off)
        if np.count_nonzero(here) < 2:
            continue
        run = np.empty(len(rows), np.int64)
        other = np.empty(len(rows), np.int64)
        run[right_order] = np.cumsum(right_shared < LENGTH - o)
        other[left_order] = np.cumsum(left_shared < o)
        at = np.flatnonzero(here)
        both = run[at] * (len(rows) + 1) + other[at]
        sort = np.argsort(both, kind="stable")
        ordered = both[sort]
        equal = ordered[1:] == ordered[:-1]
        twin = np.zeros(len(at), bool)
        twin[1:] |= equal
        twin[:-1] |= equal
        hit = at[sort[twin]]
        hit = hit[~known[hit]]
        if len(hit):
            found.append(np.stack((hit, lo[hit] + off[hit] - o), axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _spans(ids: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """[lo, hi) spans that strings at ``starts`` cover, those that touch united."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + LENGTH)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(ids)])) - 1
    return {"id": ids[first], "lo": starts[first], "hi": starts[last] + LENGTH}


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, whole classes side by side, in blocks of bounded size to spans."""
    schema = _arrow("id long, lo int, hi int")

    def solve(block: list[tuple]) -> pa.RecordBatch | None:
        hits = repeated_starts([r[1:] for r in block])
        if not len(hits):
            return None
        return _batch(schema, _spans(np.array([r[0] for r in block], np.int64)[hits[:, 0]], hits[:, 1]))

    block: list[tuple] = []
    pending: list[tuple] = []
    size, cls = 0, None
    for batch in batches:
        for i, lo, span, off, c, twice, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != cls:
                # One context alone has no partner.
                if len(pending) > 1:
                    block += pending
                    size += sum(len(r[5]) for r in pending)
                pending, cls = [], c
                if size >= SORT_BYTES:
                    if (out := solve(block)) is not None:
                        yield out
                    block, size = [], 0
            pending.append((i, lo, span, off, twice, text))
    if len(pending) > 1:
        block += pending
    if block and (out := solve(block)) is not None:
        yield out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of frequent classes' contexts as a digest."""
    schema = _arrow("id long, lo int, twice boolean, d1 long, d2 long")
    for batch in common.pieces(batches, 6):
        out: dict[str, list] = {f.name: [] for f in schema}
        for i, lo, span, _, _, twice, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            for k in range(span + 1):
                d = xxhash.xxh3_128_digest(text[k : k + LENGTH])
                out["id"].append(i)
                out["lo"].append(lo + k)
                out["twice"].append(twice)
                out["d1"].append(int.from_bytes(d[:8], "little", signed=True))
                out["d2"].append(int.from_bytes(d[8:], "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def _frequent(rows: DataFrame, share: float, least: int) -> tuple[list[int], list[tuple[int, int, int, int, int]]]:
    """Classes and contexts that hold a great share of a sample of the texts, at most 1 / share of each.

    A context comes with one of its places. They only steer how rows are dealt:
    a context that the sample holds twice is known to be repeated.
    """
    sample = _anchor_rows(rows.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0))
    sample = sample.groupBy("cls", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("id", "lo")).alias("at"))
    sample = common.stored(sample, "anchor-sample")
    total = sample.agg(F.sum("n").alias("n")).first().n or 0
    bound = max(least, share * total)
    classes = sample.groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= bound).select("cls").collect()
    contexts = sample.where(F.col("n") >= max(2, bound)).collect()
    return sorted(r.cls for r in classes), sorted((r.cls, r.c1, r.c2, r.at.id, r.at.lo) for r in contexts)


def _dealt(anchors: DataFrame, classes: list[int], contexts: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Anchors with a salt: 0 for most, 1 to SALTS by context within frequent classes, and below 0, by text, for frequent contexts.

    The named place of a frequent context has the salt SALTS + 1 and goes on to meet other contexts.
    """
    if not classes:
        return anchors.withColumn("salt", F.lit(0))
    salt = F.when(F.col("cls").isin(classes), 1 + F.pmod("c1", F.lit(SALTS))).otherwise(0)
    if not contexts:
        return anchors.withColumn("salt", salt.cast("int"))
    known = anchors.sparkSession.createDataFrame(contexts, "cls long, c1 long, c2 long, _id long, _lo long")
    met = anchors.join(F.broadcast(known), ["cls", "c1", "c2"], "left")
    named = (F.col("_id") == F.col("id")) & (F.col("_lo") == F.col("lo"))
    spread = -1 - F.pmod(F.xxhash64("id", "lo"), F.lit(SALTS))
    return met.withColumn("salt", F.when(F.col("_id").isNull(), salt).when(named, SALTS + 1).otherwise(spread).cast("int"))


def repeated_spans(
    rows: DataFrame, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS, class_size: int = CLASS_SIZE
) -> DataFrame:
    """(id, lo, hi) of repeated bytes of ``rows`` (id, text), ids unlike for unlike texts; spans of one text may overlap."""
    hot, contexts = _frequent(rows, hot_share, hot_rows)
    salted = _dealt(_anchor_rows(rows), hot, contexts)
    met = (
        salted.repartition("cls", "salt").sortWithinPartitions("cls", "salt", "c1", "c2")
        .select("id", "lo", "span", "off", "cls", "salt", "c1", "c2")
        .mapInArrow(_met, "id long, lo int, span short, off short, cls long, salt int, twice boolean, wanted boolean")
    )
    met = common.stored(met, "anchors")
    wanted = met.where("wanted").select("id", "lo", "span", "off", "cls", "twice")
    # Classes of more contexts than a task should sort take another road; their number is known exactly here.
    large = common.stored(wanted.groupBy("cls").count().where(F.col("count") > class_size).select("cls"), "large-classes")
    some = not large.isEmpty()
    if some:
        wanted = wanted.join(large.withColumn("_l", F.lit(True)), "cls", "left").withColumn("large", F.col("_l").isNotNull())
    else:
        wanted = wanted.withColumn("large", F.lit(False))
    wanted = wanted.groupBy("id").agg(F.collect_list(F.struct("lo", "span", "off", "cls", "large", "twice")).alias("found"))
    # What grows with the texts is never a side to broadcast, also where it is still small.
    texts = rows.join(wanted.hint("merge"), "id").select("id", "text", "found").mapInArrow(_contexts, _CONTEXT)
    columns = ["id", "lo", "span", "off", "cls", "twice", "text"]
    if some:
        texts = common.stored(texts, "contexts")
    small = texts.where("NOT large").repartition("cls").sortWithinPartitions("cls").select(*columns)
    found = small.mapInArrow(_sorted_out, "id long, lo int, hi int")
    if some:
        strings = texts.where("large").select(*columns).mapInArrow(_digests, "id long, lo int, twice boolean, d1 long, d2 long")
        again = strings.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2")
        more = strings.join(again, ["d1", "d2"]).where("NOT twice")
        found = found.union(more.select("id", "lo", (F.col("lo") + LENGTH).cast("int").alias("hi")))
    found = common.stored(found, "repeats")
    whole = met.where("twice").select("id", "lo", (F.col("lo") + F.col("span") + LENGTH).cast("int").alias("hi"))
    return whole.union(found)


def _cut(text: str | None, spans: list) -> tuple[bytes, int, int, list[tuple[int, int]]]:
    """Kept bytes, bytes, bytes removed and the maximal removed runs."""
    data = (text or "").encode()
    runs: list[tuple[int, int]] = []
    for a, b in sorted((s["lo"], s["hi"]) for s in spans or []):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), len(data), sum(b - a for a, b in runs), runs


def deduplicated(documents: DataFrame, key: str = "doc_id", **limits) -> DataFrame:
    """(key, kept binary, n_bytes, n_removed, spans) of every row of ``documents``.

    Null texts count as empty; texts under LENGTH bytes are never cut. Very long
    texts are hashed in parts of SCAN_BYTES and cut whole. Repeated rows are copies
    of each other, and of equal strings none is spared. Where keys repeat or are
    null, rows are told apart by a hash of key and text. An empty table gives no
    row. Other columns are neither read nor kept, so that no name clashes.
    """
    common.importable(documents.sparkSession)
    rows = documents.select(F.col(key).alias("_k"), "text")
    clash = rows.groupBy("_k").count().where("count > 1 OR _k IS NULL")
    unlike = not clash.isEmpty() or dict(rows.dtypes)["_k"] not in ("bigint", "int", "smallint", "tinyint")
    identity = F.xxhash64("_k", "text") if unlike else F.col("_k").cast("long")
    rows = rows.withColumn("id", identity)
    spans = repeated_spans(rows.select("id", "text"), **limits)
    cuts = spans.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    schema = f"{key} {dict(documents.dtypes)[key]}, kept binary, n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 1):
            keys, texts, found = (batch.column(i).to_pylist() for i in range(3))
            done = [_cut(t, s) for t, s in zip(texts, found, strict=True)]
            columns = [
                keys, [d[0] for d in done], [d[1] for d in done], [d[2] for d in done],
                [[{"lo": a, "hi": b} for a, b in d[3]] for d in done],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.join(cuts.hint("merge"), "id", "left").select("_k", "text", "spans").mapInArrow(run, schema)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op7_substring": op7_substring}

ORACLE = {
    "op7_substring": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM d, unnest(generate_series(1, octet_length(b) - 199)) AS g(i)),
r AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) AS t USING (h)),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
t AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS e FROM t GROUP BY 1, 2),
keep AS (SELECT doc_id, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda k: e[k] - a[k])), 0) AS BIGINT) AS n_removed,
  CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN hex(b) ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda k: hex(b[(CASE WHEN k = 0 THEN 1 ELSE e[k] END):(CASE WHEN k = len(a) THEN octet_length(b) ELSE a[k + 1] - 1 END)])), '') END)) AS kept_sha256
FROM d LEFT JOIN keep USING (doc_id)"""
}
