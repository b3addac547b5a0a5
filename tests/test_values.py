import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_canonical_text(spark):
    made = [V.string_value(F.lit("abc")), V.int_value(F.lit(42)), V.float_value(F.lit(3.5)), V.bool_value(F.lit(True))]
    assert [one(spark, V.canonical(m)) for m in made] == ["abc", "42", "3.5", "true"]
    missing = V.fields_of(a=V.int_value(F.lit(1)))["b"]
    assert one(spark, V.canonical(missing)) == ""


@pytest.mark.parametrize(
    "x, text",
    [
        (0.0, "0"), (-0.0, "-0"), (3.0, "3"), (123456.0, "123456"), (1e6, "1e+06"), (1234567.0, "1.234567e+06"), (0.0001, "0.0001"),
        (0.00001, "1e-05"), (-2.5e-7, "-2.5e-07"), (1e100, "1e+100"), (0.1, "0.1"), (99999.5, "99999.5"), (float("inf"), "+Inf"),
        (float("-inf"), "-Inf"), (float("nan"), "NaN"), (5e-324, "5e-324"), (2.0**53, "9.007199254740992e+15"),
    ],
)
def test_float_text(spark, x, text):
    assert one(spark, V.float_text(F.lit(x))) == text


def test_float_text_reads_back(spark):
    rng = random.Random(4)
    xs = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 30) for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", V.float_text(F.col("x")).alias("t")).collect()
    assert all(float(r.t) == r.x for r in got)


def test_decode_fields(spark):
    text = '{"a":"x","b":3,"c":3.0,"d":2.5,"e":true,"f":null,"g":1e2,"h":9007199254740993,"i":1e30}'
    got = one(spark, V.decode_fields(F.lit(text)))
    assert {k: v.type for k, v in got.items()} == dict(a="string", b="int", c="int", d="float", e="bool", f="string", g="int", h="int", i="float")
    assert (got["b"].i, got["c"].i, got["d"].f, got["e"].b, got["f"].s, got["g"].i, got["h"].i) == (3, 3, 2.5, True, "", 100, 9007199254740993)
    assert one(spark, V.decode_fields(F.lit("{}"))) == {}


@pytest.mark.parametrize("bad", ['{"a":[1]}', '{"a":{"b":1}}'])
def test_decode_fields_names_the_field(spark, bad):
    with pytest.raises(Exception, match="cannot decode field"):
        one(spark, V.decode_fields(F.lit(bad)))


@pytest.mark.parametrize("id, rank, back", [("t-v9", 9, 9), ("t-v10", 10, 1), ("t-v12", 12, 21), ("t", 0, 0), ("", 0, 0)])
def test_version_rank(spark, id, rank, back):
    assert one(spark, V.version_rank(F.lit(id))) == rank
    assert one(spark, V.version_rank(F.lit(id), True)) == back


def test_quoted_name(spark):
    assert one(spark, V.quoted(F.lit('a"b'))) == '"a\\"b"'


@pytest.mark.parametrize("key, parsed", [("  ", None), (" user_ok ", "user_ok"), ("\t　x\n", "x"), ("é" * 128, "é" * 128), ("é" * 129, None), ("", None)])
def test_parse_entity(spark, key, parsed):
    assert one(spark, K.parse_entity(F.lit(key))) == parsed
    if parsed is None:
        with pytest.raises(Exception, match="entity key"):
            one(spark, K.require_entity(F.lit(key)))


def test_hash_and_slot_match_the_public_algorithm(spark):
    names = ["", "a", "abc", *[f"user_{i}" for i in range(300)], "ключ", "x" * 100]
    frame = spark.createDataFrame([(n,) for n in names], "e string")
    e = F.col("e")
    for r in frame.select("e", K.hash_key(e).alias("h"), K.slot(e, 16).alias("a"), K.slot(e, 7).alias("b"), K.slot(e, 0).alias("c")).collect():
        h = xxhash.xxh64_intdigest(r.e.encode(), 0)
        assert (r.h % 2**64, r.a, r.b, r.c) == (h, h % 16, h % 7, 0)


def test_expansion():
    router = K.Router(16)
    e = router.expand(64)
    assert (e.previous, e.current, e.added) == (16, 64, 48)
    for bad in (64, 8, 0):
        with pytest.raises(ValueError):
            router.expand(bad)
    with pytest.raises(ValueError):
        K.Router(0)
    assert (router.shard_state(0), router.shard_state(64), router.shard_state(-1)) == (0, -1, -1)


def test_reachable_without_moving(spark):
    frame = spark.range(1500).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("e"))
    assert frame.where(K.reachable(F.col("e"), 16, 64)).count() == 400
