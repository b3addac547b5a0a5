"""Near duplicates and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import neardup, shingles, substring
from tessera.llm.components import connected_components
from tessera.llm.suffix_sort import common_prefix, deep_shallow


def test_deep_shallow_sorts():
    rng = random.Random(1)
    for _ in range(120):
        letters = rng.choice([b"ab", b"\0a", bytes(range(256))])
        text = lambda n: bytes(rng.choice(letters) for _ in range(rng.randint(0, n)))  # noqa: E731, B023
        head = text(130)
        strings = [(head if rng.random() < 0.7 else b"") + text(25) for _ in range(rng.randint(0, 150))]
        order, shared = deep_shallow(strings)
        assert order.tolist() == sorted(range(len(strings)), key=lambda i: (strings[i], i))
        for i in range(1, len(order)):
            assert shared[i] == common_prefix(strings[order[i - 1]], strings[order[i]])


def brute_cut(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def passages(rng):
    """Texts that share passages of about the length, whole copies, periods, and parts of each other."""
    letters = "abcdé \n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (150, 199, 200, 201, 260, 700)]
    out = [None, "", "x", text(199), text(200), "ab" * 300, "ab" * 90, "a" * 199, "a" * 200, "a" * 201, "😀" * 80]
    for _ in range(40):
        out.append(text(rng.randint(0, 200)) + rng.choice(shared)[rng.randint(0, 30) :] + text(rng.randint(0, 90)) + rng.choice(shared) + text(rng.randint(0, 90)))
    return out + out[-5:] + [out[-1] + "!", "?" + out[-2]]


@pytest.mark.parametrize("limits", [{}, {"class_size": 2}, {"hot_share": 0.0, "hot_rows": 1}, {"hot_share": 0.0, "hot_rows": 1, "class_size": 1}])
def test_substrings_match_brute_force(spark, docs, limits, monkeypatch):
    monkeypatch.setattr(substring, "HOT_SAMPLE", 1 if "hot_rows" in limits else 64)
    texts = passages(random.Random(3))
    wanted = brute_cut(texts)
    for r in substring.deduplicated(docs(texts), **limits).collect():
        n, gone, runs, digest = wanted[r.doc_id]
        assert (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) == (n, gone, runs, digest), r.doc_id


def test_substrings_of_long_texts_in_parts(spark, docs, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(5000))
    texts = [text, text[1000:3000] + "z" * 50, "q" + text[2500:2800]]
    for size in (600, 1 << 20):
        found = [substring.anchors([t.encode() for t in texts])] if size else []
        assert len(found[0]["doc"])
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans)) for r in substring.deduplicated(docs(texts)).collect()}
    assert got == {i: x[:3] for i, x in enumerate(brute_cut(texts))}


def test_anchors_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(6000))
    cover = lambda f: sorted((lo + k, lo + off) for lo, span, off in zip(f["lo"], f["span"], f["off"], strict=True) for k in range(span + 1))
    whole = cover(substring.anchors([text]))
    monkeypatch.setattr(substring, "SCAN_BYTES", 700)
    assert cover(substring.anchors([text])) == whole
    assert [s for s, _ in whole] == list(range(6000 - 199))


def test_meeting_anchors_across_batches():
    rng = random.Random(6)
    names = ["id", "lo", "span", "off", "cls", "salt", "c1", "c2"]
    types = [pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for _ in range(300):
        keys = sorted((rng.randint(0, 3), 0, rng.randint(0, 2), rng.randint(0, 1)) for _ in range(rng.randint(1, 25)))
        rows = [(i, i, 3, 1, c, s, a, b) for i, (c, s, a, b) in enumerate(keys)]
        cuts = [0, *sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randint(0, 5)))), len(rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[x:y]], t) for k, t in enumerate(types)], names) for x, y in zip(cuts, cuts[1:], strict=False)]
        got = [r for b in substring._met(iter(batches)) for r in b.to_pylist()]
        count = Counter(k for k in keys)
        assert {r["id"] for r in got if r["twice"]} >= {r[0] for r in rows if count[keys[r[0]]] > 1}
        for c in {k[0] for k in keys}:
            contexts = {k for k in keys if k[0] == c}
            wanted = Counter(keys[r["id"]] for r in got if r["wanted"] and r["cls"] == c)
            assert wanted == ({k: 1 for k in contexts} if len(contexts) > 1 else {})


def test_repeated_rows_and_no_rows(spark, docs):
    text = "".join(random.Random(7).choice("abc") for _ in range(400))
    frame = docs([text, text + "x"], extra=False)
    rows = substring.deduplicated(frame.union(frame.limit(1)).union(frame.selectExpr("CAST(NULL AS LONG)", "text", "lang", "source", "n_chars").limit(1))).collect()
    assert len(rows) == 4 and all(r.n_removed >= 400 for r in rows)
    assert substring.deduplicated(frame.where("false")).count() == 0


def brute_groups(texts, size, percent=80):
    def shingle(t):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingle(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def edited(rng, n=60):
    words = [f"w{i}" for i in range(300)]
    out = []
    for base in range(6):
        text = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 200, 500, 700]))]
        for _ in range(n // 6):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([str.upper, str])(" ".join(copy)))
    return out


@pytest.mark.parametrize("piece", [400_000, 400])
def test_groups_match_brute_force(spark, docs, edge_texts, piece):
    texts = edge_texts + edited(random.Random(8))
    wanted = brute_groups(texts, 4)
    for r in neardup.groups(docs(texts), size=4, piece=piece).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*wanted[r.doc_id], r.doc_id == wanted[r.doc_id][1]), r


def test_one_of_each_group_stays(spark, docs):
    texts = edited(random.Random(9), 30)
    frame = docs(texts)
    kept = neardup.keep(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g for _, g in brute_groups(texts, 5).values()})
    assert neardup.keep(frame.union(frame)).count() == kept.count()
    assert neardup.keep(frame.where("false")).count() == 0


def test_groups_with_null_and_repeated_keys(spark):
    text = " ".join(f"w{i}" for i in range(50))
    frame = spark.createDataFrame([(5, text), (5, text), (None, text), (2, text + " more"), (2, "else"), (9, None)], "doc_id long, text string")
    got = neardup.groups(frame, size=4).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles > 1} == {(5, 2), (None, 2), (2, 2)}


def test_unlike_texts_under_one_key_stay(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(50))
    rows = [
        (None, text("a")), (None, text("b")), (None, text("b")), (None, text("b") + " more"), (None, None), (None, ""),
        (5, text("c")), (5, text("d")), (5, text("d")), (5, text("d") + " more"), (5, None),
        # The copy of 7 goes with 3, its other text stays.
        (3, text("e")), (7, text("e") + " more"), (7, text("f")), (None, text("f") + " more"), (9, text("g")),
    ]
    got = [tuple(r) for r in neardup.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    one = lambda key, c: sum(g in ((key, text(c)), (key, text(c) + " more")) for g in got)
    assert all(one(k, c) == 1 for k, c in ((None, "a"), (None, "b"), (5, "c"), (5, "d"), (3, "e"), (7, "f"), (9, "g")))
    assert {(None, None), (None, ""), (5, None)} <= set(got) and len(got) == 10
    found = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) in (10, 11, 12)


def order_rows(rng, n):
    """Rows of two orders with few values, so that regions are of all depths and sizes, sorted."""
    values = rng.choice([1, 2, 9], p=[0.6, 0.3, 0.1], size=(n, 8)).astype(">u2")
    values[: n // 5] = 7
    words = values.view(">i8").astype(np.int64)
    sketch = rng.choice(np.array([0, 1, 0xFFFF, 2**62], np.int64), size=(n, 3))
    rows = [rng.integers(0, 2, n), words[:, 0], words[:, 1], np.arange(n) + 1000, *sketch.T]
    order = np.lexsort(rows[3::-1])
    return [r[order] for r in rows]


def wanted_ties(rows, least):
    """Pairs of regions and near neighbours that the definition asks for, by comparing all with all."""
    n = len(rows[0])
    values = [(int(rows[0][i]), *np.array([rows[1][i], rows[2][i]], ">i8").view(">u2").tolist()) for i in range(n)]
    size = Counter(v[: 1 + d] for v in values for d in range(3, 9))
    depth = [next((d for d in range(3, 9) if size[v[: 1 + d]] <= neardup.LEAF), None) for v in values]
    agree = lambda i, j: 192 - sum((int(s[i]) ^ int(s[j])).bit_count() if int(s[i]) >= 0 and int(s[j]) >= 0 else ((int(s[i]) ^ int(s[j])) & (2**64 - 1)).bit_count() for s in rows[4:])
    for i in range(n):
        for j in range(i + 1, n):
            if depth[i] is None and depth[j] is None and values[i] == values[j] and j == i + 1:
                yield i, j
            elif depth[i] and depth[i] == depth[j] and values[i][: 1 + depth[i]] == values[j][: 1 + depth[i]] and agree(i, j) >= least:
                yield i, j
            elif j - i <= neardup.NEAR and values[i][:4] == values[j][:4] and agree(i, j) >= least:
                yield i, j


def test_regions_of_an_order(monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 6)
    for seed in range(30):
        rows = order_rows(np.random.default_rng(seed), 150)
        a, b = neardup.tied(rows, 190)
        root = {int(y): int(x) for x, y in zip(a, b, strict=True)}
        at = rows[3].tolist()
        pairs = list(wanted_ties(rows, 190))
        assert pairs and all(root.get(at[i], at[i]) == root.get(at[j], at[j]) for i, j in pairs)
        # Nothing else ties rows: as many trees as the pairs have.
        parent = list(range(150))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in pairs:
            parent[find(j)] = find(i)
        assert len({find(i) for i in range(150)}) == 150 - len(root)


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_regions_across_cuts(spark, parts):
    rows = order_rows(np.random.default_rng(parts), 700)
    frame = spark.createDataFrame([tuple(int(r[i]) for r in rows) for i in range(700)], "tree int, hi long, lo long, id long, s0 long, s1 long, s2 long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        links = neardup.candidates(frame, 80).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    root = {i: i for i in range(1000, 1700)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    at = rows[3].tolist()
    assert all(find(at[i]) == find(at[j]) for i, j in wanted_ties(rows, neardup.least_agreement(80)))


def test_signatures_agree_with_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:2700], rng.integers(0, 2**63, 300, dtype=np.uint64))))
    same, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    for make in (shingles.permuted_signature, shingles.binned_signature):
        assert abs(np.mean(make(a) == make(b)) - same / union) < 0.12


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(11)
    text = "".join(rng.choice("ab \n\t") for _ in range(9000)) + "c" * 3000
    whole = shingles.shingle_sets(["x y", text, "z"], 4)
    monkeypatch.setattr(shingles, "CHUNK", 500)
    for a, b in zip(whole, shingles.shingle_sets(["x y", text, "z"], 4), strict=True):
        assert (a == b).all() and len(a)


def test_sketch_bound():
    """Pairs of just the wanted similarity agree in more bits than the bound, far less similar ones in fewer."""
    rng = np.random.default_rng(2)
    least = neardup.least_agreement(80)
    agree = lambda x, y: S_VALUES - int(np.bitwise_count((shingles.sketch(x) ^ shingles.sketch(y)).view(np.uint64)).sum())
    S_VALUES = shingles.VALUES
    for n, make in ((60, shingles.permuted_signature), (500, shingles.permuted_signature), (900, shingles.binned_signature)):
        for _ in range(40):
            h = np.unique(rng.integers(0, 2**64, n + n // 4, dtype=np.uint64))
            a, b = np.sort(rng.permutation(h)[: n + n // 8]), h
            near = np.unique(np.concatenate((a, b[: len(b) // 10])))
            assert agree(make(a), make(near)) >= least
            assert agree(make(a), make(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)))) < least


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (200, 201), (201, 200), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
