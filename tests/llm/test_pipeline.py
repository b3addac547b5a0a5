"""The corpus pipeline: every stage on rows with nulls, repeats and clashing names, and all of them on end."""

import random
import zlib

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import common, decontaminate, mixing, neardup, quality, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def corpus(spark, tmp_path):
    """A folder with documents, labels and benchmark, and the documents by id."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    text = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(n // 9)) + "."
    item = " ".join(rng.choice(words) for _ in range(14))
    rows = [(i, text(rng.choice([45, 90, 270])), "en", "web" if i % 3 else "books") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "web"), (102, "too short", "en", "web"), (103, "again and again " * 60, "en", "web")]
    rows += [(200 + i, rows[i][1], "en", "web") for i in range(5)] + [(210 + i, rows[i][1] + " tail", "en", "books") for i in range(5)]
    rows += [(300, text(90) + " " + item.upper() + " " + text(45), "en", "web"), (301, text(99), None, None), (302, "word " + text(9000), "en", "long")]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 103), 0) for i in (1, 2, 3, 103)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {r[0]: r for r in rows}


def stage(name):
    return dict(P.STAGES)[name]


def test_stages_are_named_in_order():
    assert [n for n, _ in P.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "token shards"]
    assert all(f.__doc__ for _, f in P.STAGES) and P.ORACLE_SQL is None


def test_stages_one_by_one(spark, corpus):
    folder, rows = corpus
    docs = common.table(spark, folder, "documents")
    kept = stage("quality rules")(spark, docs, folder)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    # Null, empty, short and repetitive texts go; clean ones stay.
    assert ids == set(rows) - {100, 101, 102, 103}
    single = stage("near duplicates")(spark, kept, folder)
    assert single.columns == COLUMNS
    # Copies and texts with a longer tail go with the smallest id of their group.
    assert {r.doc_id for r in single.collect()} == ids - {*range(200, 205), *range(210, 215)}
    clean = stage("decontamination")(spark, single, folder)
    assert clean.columns == COLUMNS
    assert {r.doc_id for r in clean.collect()} == {i for i in ids if i < 200 or i > 300}
    mix = stage("mixing")(spark, clean, folder)
    assert mix.columns == COLUMNS
    drawn = {r.doc_id: r.copies for r in mixing.drawn(clean).collect()}
    assert sorted(r.doc_id for r in mix.collect()) == sorted(i for i, n in drawn.items() for _ in range(n))
    shards = stage("token shards")(spark, mix, folder).collect()
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    start = 0
    for r in sorted(shards, key=lambda r: r.start):
        ids = [*plain.encode(rows[r.doc_id][1], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
    assert sorted(r.doc_id for r in shards) == sorted(r.doc_id for r in mix.collect())


def test_run_is_the_stages_on_end(spark, corpus):
    folder, _ = corpus
    docs = common.table(spark, folder, "documents")
    docs = quality.keep(docs, common.table(spark, folder, "labels"))
    docs = mixing.mixed(decontaminate.clean(neardup.keep(docs), common.table(spark, folder, "benchmark")))
    wanted = tokens.encoded(docs).collect()
    got = P.run(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and len(got) > 40


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_any_rows(spark, corpus, name):
    """No rows; and rows with null keys, repeated rows, extra columns whose names the operators use themselves."""
    folder, _ = corpus
    docs = common.table(spark, folder, "documents")
    assert stage(name)(spark, docs.where("false"), folder).count() == 0
    extra = {c: F.lit("mine") for c in ("_row", "_key", "_id", "_words", "_s", "_h", "_k", "_b", "id", "key", "n_words", "kept", "copies", "a.b")}
    odd = docs.union(docs.where("doc_id IN (1, 2)")).union(docs.where("doc_id IN (3, 4, 100)").withColumn("doc_id", F.lit(None).cast("long"))).withColumns(extra)
    found = stage(name)(spark, odd, folder)
    if name != "token shards":
        assert found.columns == odd.columns
        assert {r["a.b"] for r in found.select("`a.b`").collect()} == {"mine"}
    # A source that is weighted below its share may lose its only text.
    assert found.where("doc_id = 302 OR doc_id = 7").count() > 0


def test_sessions_keep_their_settings(spark, corpus):
    folder, _ = corpus
    before = {k: v for k, v in spark.conf.getAll.items()}
    P.run(spark, folder).collect()
    assert {k: v for k, v in spark.conf.getAll.items()} == before
