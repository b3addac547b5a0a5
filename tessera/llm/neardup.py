"""Near-duplicate documents by an LSH forest, with links confirmed on full shingle sets.

1. Each text becomes its set of word shingles, a digest of it and a min-hash
   signature. Texts with equal sets are one class; one of each goes on.
2. The forest keeps TREES sorted orders of the signatures: in each, a text is the
   sequence of its DEPTH min-hash values. The longest common prefixes of an order
   part it into regions, of prefixes as long as the region's density asks for: the
   shortest from THIN values on that LEAF texts or fewer share. The texts of a
   region, and each text and its NEAR neighbours by common prefix, are candidates
   if their sketches, a bit of every value, leave the similarity possible. Texts
   that candidates tie together in a region are sent on as a tree of links, so that
   these grow with the texts and not with the square of a region.
3. Tied texts form blocks. A block's sets meet in one task, where an inverted index
   counts their intersections; blocks too large for a task are resolved in pieces.
4. Components of the confirmed links name the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm import shingles as S
from tessera.llm.components import connected_components

#: Orders, values of a text in each, and the shortest prefix that makes candidates.
TREES, DEPTH, THIN = 24, 8, 3
#: Texts of a region that are all compared, and neighbours that are compared in any region.
LEAF, NEAR = 64, 4
#: Deviations below its mean from which a sketch's agreement rules a pair out: one pair in a thousand million.
SIGMAS = 6.0
#: Rows of an order that are looked at together.
ROWS = 20_000
#: Shingles that a task resolves together; a larger block goes piece by piece.
PIECE = 100_000

_BASE = "id long, key {key}, n long, d1 long, d2 long, tree array<int>, hi array<long>, lo array<long>, sketch array<long>"
_WORDS = S.VALUES // 64


def _trees(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orders that a set is in, its values in each as two big-endian words, and its sketches.

    Sets of a size that both kinds of signature serve are in the orders of both.
    """
    kinds = []
    if 0 < len(hashes) <= S.PERMUTED_TO:
        kinds.append((0, S.permuted_signature(hashes)))
    if len(hashes) >= S.BINNED_FROM:
        kinds.append((1, S.binned_signature(hashes)))
    none = np.zeros(0, np.int64)
    if not kinds:
        return none, none.reshape(0, 2), none
    trees = np.concatenate([np.arange(TREES) + TREES * kind for kind, _ in kinds])
    words = np.concatenate([s.astype(">u2").view(">i8").astype(np.int64).reshape(TREES, 2) for _, s in kinds])
    return trees, words, np.concatenate([S.sketch(s) for _, s in kinds])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind))


def _signed(documents: DataFrame, size: int, key_type: str) -> DataFrame:
    """One row for each text: shingle count, digest of the set, and its places in the orders."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = _BASE.format(key=key_type)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 2):
            sets = S.shingle_sets(batch.column(2).to_pylist(), size)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            places = [_trees(s) for s in sets]
            columns = [
                batch.column(0), batch.column(1), [len(s) for s in sets], digests[:, 0], digests[:, 1],
                _lists([p[0] for p in places], pa.int32()), *(_lists([p[1][:, i] for p in places], pa.int64()) for i in (0, 1)),
                _lists([p[2] for p in places], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)],
                schema=arrow,
            )

    common.importable(documents.sparkSession)
    return documents.select("id", "key", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- candidates

#: Columns of an order's rows, sorted by the first four: order, values, text, sketch.
_ORDER = ["tree", "hi", "lo", "id", *[f"s{i}" for i in range(_WORDS)]]
_FOUND = "kind int, part int, a long, b long, tree int, hi long, lo long, id long, " + ", ".join(f"s{i} long" for i in range(_WORDS))


def common_prefixes(tree: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """How many values each row shares with the one before; the first row, and the first of an order, -1."""
    out = np.full(len(tree), -1, np.int8)
    if len(tree) > 1:
        x, y = ((w[1:] ^ w[:-1]).view(np.uint64) for w in (hi, lo))
        shared = sum(((x >> np.uint64(64 - 16 * k)) == 0).astype(np.int8) for k in range(1, 5))
        shared += sum(((x == 0) & ((y >> np.uint64(64 - 16 * k)) == 0)).astype(np.int8) for k in range(1, 5))
        out[1:] = np.where(tree[1:] == tree[:-1], shared, -1)
    return out


def least_agreement(percent: int) -> int:
    """Bits of the sketches that a pair of the wanted similarity has in common at least."""
    p = (1 + percent / 100) / 2
    return math.floor(S.VALUES * p - SIGMAS * math.sqrt(S.VALUES * p * (1 - p)))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that pairs (a, b) tie each of ``n`` rows to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def tied(rows: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the texts that candidates tie together among rows of _ORDER."""
    tree, hi, lo, ids, *sketch = rows
    n = len(ids)
    shared = common_prefixes(tree, hi, lo)
    # A row's region: that of the shortest prefix which no more than LEAF rows share.
    region, thin = np.full(n, -1, np.int64), np.zeros(0)
    for depth in range(THIN, DEPTH + 1):
        run = np.cumsum(shared < depth) - 1
        thin = run if depth == THIN else thin
        fits = (np.bincount(run)[run] <= LEAF) & (region < 0)
        region[fits] = run[fits] * (DEPTH + 1) + depth
    # The whole sequence is shared by more: such rows are tied in order, without a look at their sketches.
    dense = np.flatnonzero((region[1:] < 0) & (region[:-1] < 0) & (shared[1:] == DEPTH))
    found = [(dense, dense + 1)]
    at = np.arange(n)
    for k in range(1, min(LEAF, n)):
        at = at[at + k < n]
        same = (region[at] == region[at + k]) & (region[at] >= 0)
        if k <= NEAR:
            pairs = at[same | (thin[at] == thin[at + k])]
        else:
            # Rows whose region ends within k rows have no partner further on.
            pairs = at = at[same]
        if not len(pairs) and k > NEAR:
            break
        differ = sum(np.bitwise_count((s[pairs] ^ s[pairs + k]).view(np.uint64)).astype(np.int64) for s in sketch)
        near = pairs[S.VALUES - differ >= least]
        found.append((near, near + k))
    a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    root = _roots(n, a, b)
    moved = np.flatnonzero(root != np.arange(n))
    return ids[root[moved]], ids[moved]


def _ties(least: int):
    """Rows of _ORDER, sorted, to links (kind 0), the first (1) and last (2) LEAF rows, and the number of rows, as ``a`` (3)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_FOUND))

    def out(kind: int, part: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
        columns |= {"kind": np.full(n, kind), "part": np.full(n, part)}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] | None = None
        # A region of LEAF rows or fewer that goes on in the next batch has all its rows here among the last ones.
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows = [c.to_numpy() for c in batch.columns]
            if total < LEAF:
                first = [r[: LEAF - total] for r in rows]
                yield out(1, part, len(first[0]), **dict(zip(_ORDER, first, strict=True)))
            total += batch.num_rows
            if held is not None:
                rows = [np.concatenate((h, r)) for h, r in zip(held, rows, strict=True)]
            a, b = tied(rows, least)
            if len(a):
                yield out(0, part, len(a), a=a, b=b)
            held = [r[-LEAF:].copy() for r in rows]
        if held is not None:
            yield out(2, part, len(held[0]), **dict(zip(_ORDER, held, strict=True)))
            yield out(3, part, 1, a=np.array([total]))

    return run


def candidates(orders: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the texts that candidates tie together in each order (rows of _ORDER).

    The orders are cut into ranges. The rows on both sides of a cut meet again, for
    regions that it parts; only the number of rows of each range reaches the driver.
    """
    spark = orders.sparkSession
    ties = _ties(least_agreement(percent))
    keys = _ORDER[:4]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = orders.select(*_ORDER).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    found = common.stored(ordered.mapInArrow(ties, _FOUND), "candidates")
    # Ranges between two of LEAF rows or more share a cut with both.
    cuts, cut = [], 0
    for part, n in sorted((r.part, r.a) for r in found.where("kind = 3").select("part", "a").collect()):
        cuts.append((part, 1, cut))
        cut += n >= LEAF
        cuts.append((part, 2, cut))
    ends = found.where("kind IN (1, 2)").join(F.broadcast(spark.createDataFrame(cuts, "part int, kind int, cut int")), ["part", "kind"])
    again = ends.select("cut", *_ORDER).distinct().repartition("cut").sortWithinPartitions("cut", *keys)
    more = again.select(*_ORDER).mapInArrow(ties, _FOUND)
    return found.where("kind = 0").select("a", "b").union(more.where("kind = 0").select("a", "b")).where("a <> b")


# ---------------------------------------------------------------- confirmation


def resolve(ids: list[int], sets: list[np.ndarray], percent: int, old: int = 0) -> list[tuple[int, int]]:
    """Links of sets with percent/100 similarity or more, as few as show their components.

    Every set is compared with all later ones that it is not tied to yet; of the
    first ``old`` sets, pairs among themselves are skipped.
    """
    m = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(at, kind="stable")
    posting, count = owner[order], np.bincount(at, minlength=len(values))
    start, end = np.cumsum(count) - count, np.cumsum(sizes)
    root = np.arange(m)
    links: list[tuple[int, int]] = []
    for k in range(m - 1 if not old else m):
        if (root[max(k + 1, old) :] == root[k]).all():
            continue
        own = at[end[k] - sizes[k] : end[k]]
        own = own[count[own] > 1]
        if not len(own):
            continue
        n = count[own]
        done = np.cumsum(n)
        met = np.bincount(posting[np.repeat(start[own] - (done - n), n) + np.arange(done[-1])], minlength=m)
        hit = np.flatnonzero(100 * met >= percent * (sizes + sizes[k] - met))
        for j in hit[hit > k].tolist():
            if k < old and j < old or root[j] == root[k]:
                continue
            links.append((ids[k], ids[j]))
            root[root == root[j]] = root[k]
    return links


def _resolver(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (task, old, id, set), tasks side by side and old ones first, to links."""

        def done(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
            rows.sort(key=lambda r: (-r[0], r[1]))
            links = resolve([r[1] for r in rows], [np.frombuffer(r[2], "<u8") for r in rows], percent, sum(r[0] for r in rows)) if len(rows) > 1 else []
            if links:
                return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])
            return None

        task, rows = None, []
        for batch in batches:
            for t, old, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != task and rows:
                    if (out := done(rows)) is not None:
                        yield out
                    rows = []
                task = t
                rows.append((old, i, s))
        if rows and (out := done(rows)) is not None:
            yield out

    return run


def _confirmed(tasks: DataFrame, percent: int) -> DataFrame:
    """Links of the sets that meet in a task: rows (task, old, id, set)."""
    met = tasks.select("task", "old", "id", "set").repartition("task").sortWithinPartitions("task")
    return met.mapInArrow(_resolver(percent), "a long, b long")


def _sets(documents: DataFrame, size: int) -> DataFrame:
    """(id, block, size, set) of documents (id, text, block, size), the size being the block's shingles."""
    arrow = pa.schema([("id", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 3):
            sets = [s.astype("<u8").tobytes() for s in S.shingle_sets(batch.column(3).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sets, pa.binary())], schema=arrow)

    return documents.select("id", "block", "size", "text").mapInArrow(run, "id long, block long, size long, set binary")


def _large(sets: DataFrame, percent: int, piece: int) -> DataFrame:
    """Links in blocks of more than ``piece`` shingles.

    First each piece meets itself and the block's first piece. Then the texts
    outside the block's largest component so far meet every piece: pairs within
    that component need no more links, all other pairs are compared.
    """
    pieces = F.ceil(F.col("size") / piece).cast("int")
    sets = common.stored(sets.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int")), "large-blocks")
    task = lambda *parts: F.xxhash64("block", *parts)
    own = sets.withColumn("old", F.lit(0)).withColumn("task", task(F.lit(0), F.col("piece")))
    hubs = sets.where("piece = 0 AND pieces > 1").withColumn("other", F.explode(F.sequence(F.lit(1), F.col("pieces") - 1)))
    hubs = hubs.withColumn("old", F.lit(1)).withColumn("task", task(F.lit(0), F.col("other")))
    columns = ["task", "old", "id", "set"]
    first = common.stored(_confirmed(own.select(*columns).union(hubs.select(*columns)), percent), "large-links")
    groups = common.stored(connected_components(first), "large-groups").withColumnRenamed("node", "id")
    known = sets.select("id", "block").join(groups, "id")
    main = known.groupBy("block", "component").count().groupBy("block").agg(F.max_by("component", F.struct("count", "component")).alias("component"))
    tied = known.join(main, ["block", "component"]).select("id")
    outside = sets.join(tied, "id", "left_anti").withColumn("part", F.lit(0))
    sizes = outside.groupBy("block").agg(F.ceil(F.sum(F.octet_length("set") / 8) / piece).cast("int").alias("parts"))
    outside = outside.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int"))
    queries = outside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    queries = queries.withColumn("old", F.lit(0)).withColumn("task", task(F.lit(1), F.col("part"), F.col("other")))
    against = sets.join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    against = against.withColumn("old", F.lit(1)).withColumn("task", task(F.lit(1), F.col("part"), F.col("piece")))
    # A text outside may be in both roles of a task: the query stays.
    both = queries.select(*columns).union(against.select(*columns))
    both = both.groupBy("task", "id").agg(F.min("old").alias("old"), F.first("set").alias("set"))
    return first.union(_confirmed(both, percent))


def groups(documents: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", piece: int = PIECE) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``documents``.

    Texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of
    ``size``-word shingles; a text with fewer words is one shingle. Null, empty
    and wordless texts have none and are linked with nothing. component_id is the
    smallest key reachable. Rows alike in key and text are copies that share one
    fate. Where keys repeat or are null, rows are told apart by a hash of key and
    text; of a group's unlike texts under its smallest key one is kept, null is the
    largest key. Texts of any length are hashed whole; an empty table gives no row.
    Other columns are neither read nor kept, so that no name clashes.
    """
    found = _grouped(documents, _clash(documents, key), size, percent, key, piece)
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")


def _clash(documents: DataFrame, key: str) -> bool:
    """Whether keys repeat or are null."""
    return not documents.groupBy(F.col(key).alias("key")).count().where("count > 1 OR key IS NULL").isEmpty()


def _row_id(documents: DataFrame, clash: bool, key: str) -> tuple[Column, bool]:
    """What tells rows apart: a hash of key and text, or the key itself where it does; and whether it is the hash."""
    hashed = clash or dict(documents.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint")
    # A null leaves a hash as it was: its place is hashed too.
    return F.xxhash64(F.col(key).isNull(), key, "text") if hashed else F.col(key).cast("long"), hashed


def _grouped(documents: DataFrame, clash: bool, size: int, percent: int, key: str, piece: int) -> DataFrame:
    """(id, key, n, component_id, kept) of every row: see groups."""
    made, hashed = _row_id(documents, clash, key)
    rows = documents.select(F.col(key).alias("key"), "text", made.alias("id"))
    key_type = dict(rows.dtypes)["key"]
    base = common.stored(_signed(rows, size, key_type), "signatures")
    classes = base.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("class"), F.count("*").alias("count"), F.min("n").alias("n"))
    classes = common.stored(classes, "classes")
    one = base.join(classes.select(F.col("class").alias("id")).hint("merge"), "id", "left_semi")
    one = one.select("id", "sketch", F.explode(F.arrays_zip("tree", "hi", "lo")).alias("t"))
    # Where a set is in the orders of both kinds, the second kind's sketch follows the first's.
    second = F.when((F.col("t.tree") >= TREES) & (F.size("sketch") > _WORDS), _WORDS).otherwise(0)
    orders = one.select("t.tree", "t.hi", "t.lo", "id", *[F.get("sketch", second + i).alias(f"s{i}") for i in range(_WORDS)])
    blocks = connected_components(candidates(orders, percent))
    # The blocks grow with the texts: never a side to broadcast, also where it is still small.
    counted = classes.select(F.col("class").alias("id"), "n").hint("merge")
    blocks = common.stored(blocks.select(F.col("node").alias("id"), F.col("component").alias("block")).join(counted, "id"), "blocks")
    sizes = blocks.groupBy("block").agg(F.sum("n").alias("size"))
    wanted = rows.dropDuplicates(["id"]) if hashed else rows
    sets = _sets(wanted.join(blocks.select("id", "block").join(sizes, "block").hint("merge"), "id"), size)
    large = not sizes.where(F.col("size") > piece).isEmpty()
    if large:
        sets = common.stored(sets, "sets")
    small = sets.where(F.col("size") <= piece).select(F.col("block").alias("task"), F.lit(0).alias("old"), "id", "set")
    links = _confirmed(small, percent)
    if large:
        links = links.union(_large(sets.where(F.col("size") > piece), percent, piece))
    linked = connected_components(common.stored(links, "confirmed"))
    known = classes.join(linked.select(F.col("node").alias("class"), "component"), "class", "left")
    known = known.select("d1", "d2", F.coalesce("component", "class").alias("group"))
    # Texts without a shingle, however many, are linked with nothing; a class of very many copies is met by a broadcast.
    named = base.select("id", "key", "n", "d1", "d2")
    met = common.hot_join(named.where("n > 0"), known, ["d1", "d2"], classes.select("d1", "d2", "count"))
    named = met.select("id", "key", "n", "group").union(named.where("n = 0").select("id", "key", "n", F.col("id").alias("group")))
    if hashed:
        named = common.stored(named, "named")
        first = F.min_by("id", F.struct(F.col("key").isNull(), "key", "id"))
        least = named.groupBy("group").agg(F.min("key").alias("component_id"), first.alias("_first"))
        found = common.hot_join(named, least, ["group"])
        return found.select("id", "key", "n", "component_id", (F.col("id") == F.col("_first")).alias("kept"))
    # Keys are their own ids: the smallest node of a component is its smallest key.
    named = named.withColumn("component_id", F.col("group").cast(key_type))
    return named.select("id", "key", "n", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def keep(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, in its own columns: the one with the smallest doc_id, null the largest; of rows alike in doc_id and text, one."""
    clash = _clash(documents, "doc_id")
    found = _grouped(documents, clash, size, percent, "doc_id", PIECE).where("kept").select(F.col("id").alias("_kept"), F.col("key").alias("_of")).distinct()
    rows = common.packed(documents, _row_id(documents, clash, "doc_id")[0].alias("_id"), F.col("doc_id").alias("_key"))
    same = F.col("_id") == F.col("_kept")
    out = rows.join(found, same & F.col("_key").eqNullSafe(F.col("_of")) if clash else same, "left_semi")
    return (out.dropDuplicates(["_id", "_key"]) if clash else out).select("_row.*")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"), size=4, percent=80)


QUERIES = {"op10_neardup": op10_neardup}

ORACLE = {
    "op10_neardup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(w[i:i + 3]) AS h FROM w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS g(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, least(x, min(y)) AS c FROM r GROUP BY 1)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, documents.doc_id) AS component_id,
  documents.doc_id = coalesce(c.c, documents.doc_id) AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN c ON c.x = documents.doc_id"""
}
