"""Decontamination, pseudonyms, tokens, mixing and URL rules."""

import hashlib
import random
import re
import zlib
from collections import Counter
from datetime import date
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import common, decontaminate, mixing, pii, registry, tokens, urls
from tessera.llm.common import table

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    frame = registry.queries()[name](spark, DIR)
    columns = sorted(frame.columns)
    found = con.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    wanted = sorted((tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == wanted


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_keep_the_session(spark, name):
    before = dict(spark.conf.getAll.items())
    assert registry.queries()[name](spark, DIR).count() > 0
    assert dict(spark.conf.getAll.items()) == before


def test_intermediate_tables_can_be_dropped(spark):
    kept = common.stored(spark.range(3).toDF("x"), "some")
    assert kept.count() == 3 and common.scratch_root(spark) in kept.inputFiles()[0]
    common.drop_scratch(spark)
    assert not spark._jvm.org.apache.hadoop.fs.Path(common.scratch_root(spark)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(common.scratch_root(spark)))


def test_hot_values_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    left = spark.range(200).selectExpr("id", "CASE WHEN id < 90 THEN 1 WHEN id < 120 THEN NULL ELSE id END AS k")
    right = spark.createDataFrame([(1, "one"), (130, "more"), (999, "none")], "k long, name string")
    got = {r.id: (r.k, r.name) for r in common.hot_join(left, right, ["k"]).collect()}
    assert got == {i: (1, "one") if i < 90 else (None, None) if i < 120 else (i, "more" if i == 130 else None) for i in range(200)}


# ------------------------------------------------------------ decontamination


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for key, item in items:
        iw = words(item)
        for i in range(max(1, len(iw) - 9) if iw else 0):
            p = iw[i : i + 10]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    found.add(str(key))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_contamination_matches_brute_force(spark, docs, edge_texts, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(1)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["a", "B", "é", "42", "x-y"]) for _ in range(n))
    items = [(1, text(14)), (2, "A b"), (10, text(10)), (3, None), (4, " "), (5, text(30)), (2, "é")]
    pieces = [t.replace("a", "A") for _, t in items if t]
    texts = edge_texts + [f"{text(rng.randint(0, 40))} {rng.choice(pieces)} {text(5)}" for _ in range(25)] + [text(60) for _ in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("mine"))
    for r in decontaminate.contamination(docs(texts), bench).collect():
        assert (r.n_words, r.n_hit, r.items) == brute_hits(texts[r.doc_id], items)
        assert r.contaminated == (r.n_hit > 0)
        inside = "".join(texts[r.doc_id][s.a : s.b] + " " for s in r.spans)
        assert len(decontaminate.words(inside)) == r.n_hit
    kept = decontaminate.clean(docs(texts), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}


def test_scanner_matches_brute_force():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["a", "b", "\u00e9"][: rng.choice([1, 2, 3])]) for _ in range(n))
    for _ in range(150):
        items = [(i, text(rng.choice([0, 1, 2, 9, 10, 11, 14, 25]))) for i in range(rng.randint(0, 5))] + [(None, None)]
        scanner = decontaminate.Scanner(items)
        for doc in [text(rng.randint(0, 40)) for _ in range(4)] + [f"{text(7)} {t} {text(3)}" for _, t in items]:
            n, spans, ids = scanner.scan(doc)
            assert (n, sum(b - a for a, b in spans), sorted(ids)) == brute_hits(doc, items)
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_automaton_memory_is_bounded():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 10))) for _ in range(20_000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(300))) for i in range(400)]
    scanner = decontaminate.Scanner(items)
    size = sum(len(t) for _, t in items)
    assert scanner.automaton()[0].get_stats()["total_size"] < 40 * size
    # A worker keeps one automaton, whichever blocks it has met.
    decontaminate.Scanner(items[:3]).automaton()
    assert len(decontaminate.Scanner._built) == 1
    assert scanner.scan(f"x {items[7][1]} y")[1:] == ([(1, 301)], {"7"})


def test_null_items_and_repeated_rows(spark, docs):
    bench = spark.createDataFrame([(None, "one two"), (3, "three four"), (3, "five"), (4, "Three, FOUR")], "item_id long, text string")
    got = [(r.n_hit, r.items, r.contaminated) for r in decontaminate.contamination(docs(["one two", "three four five", "three four five", None, "six"]), bench).orderBy("doc_id").collect()]
    assert got == [(2, [], True), (3, ["3", "4"], True), (3, ["3", "4"], True), (0, [], False), (0, [], False)]


def test_empty_benchmark(spark, docs, edge_texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(docs(edge_texts), none).collect())
    assert decontaminate.clean(docs(edge_texts), none).count() == len(edge_texts)
    assert decontaminate.contamination(docs(["a"]).where("false"), none).count() == 0


# ------------------------------------------------------------ pseudonyms


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def prf(key, tweak, i, value):
    inner = hashlib.sha256(f"{key}|{tweak}|{i}|{value}".encode()).hexdigest()
    return int(hashlib.sha256((key + inner).encode()).hexdigest()[:15], 16)


def digits_by_hand(text, key, tweak, radix=10):
    out = ""
    for k in range(0, max(1, len(text)), 20):
        c = text[k : k + 20]
        if not c:
            continue
        u, v = len(c) // 2, len(c) - len(c) // 2
        a, b = int(c[:u] or "0", radix), int(c[u:], radix)
        for i in range(8):
            m = radix ** (u if i % 2 == 0 else v)
            a, b = b, (a + prf(key, f"{tweak}/{k // 20}/{len(c)}", i, b) % m) % m
        width = lambda x, n: np.base_repr(x, radix).lower().zfill(n) if n else ""
        out += width(a, u) + width(b, v)
    return out


def feistel_by_hand(a, b, size_a, size_b, key, tweak):
    for i in range(8):
        m = size_a if i % 2 == 0 else size_b
        a, b = b, (a + prf(key, tweak, i, b) % m) % m
    return a, b


def ssn_by_hand(text, key):
    area, group, serial = map(int, text.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    a, b = feistel_by_hand(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    return f"{areas[a // 99]:03}-{a % 99 + 1:02}-{b + 1:04}"


def date_by_hand(day, key):
    n = (day - date(1900, 1, 1)).days
    a, b = feistel_by_hand(n // 229, n % 229, 319, 229, key, "date")
    return date.fromordinal(date(1900, 1, 1).toordinal() + a * 229 + b)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban_by_hand(text, key):
    digits = digits_by_hand("".join(c for c in text[4:] if c.isdigit()), key, "iban")
    turn = iter(digits)
    body = "".join(next(turn) if c.isdigit() else c for c in text[4:])
    return f"{text[:2]}{98 - mod97(body + text[:2] + '00'):02}{body}"


def alnum_by_hand(text, key, tweak):
    turn = iter(digits_by_hand("".join(c for c in text.lower() if c.isalnum()), key, tweak, 36))
    return "".join(next(turn) if c.isalnum() else c for c in text)


def test_every_kind_by_hand(spark):
    """The value alone, in a text, and look-alikes that fail validation."""
    ibans = ["DE89370400440532013000", "GB29NWBK60161331926819", "NO9386011117947"]
    token = {"AKIA": "IOSFODNN7EXAMPLE", "ghp_": "aB3" * 12, "sk-": "proj-Ab12_Cd34" * 3, "xoxb-": "1234-abcd-EFGH", "AIza": "Sy" + "aZ-_9" * 6 + "abc", "eyJ": "hbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmN"}
    wanted = {x: iban_by_hand(x, "k") for x in ibans}
    wanted |= {p + t: p + (alnum_by_hand(t, "k", "token").upper() if t == t.upper() else alnum_by_hand(t, "k", "token")) for p, t in token.items()}
    wanted["3782 822463 10005"] = (lambda d: f"{d[:4]} {d[4:10]} {d[10:]}")(card_by_hand("378282246310005", "k"))
    wanted["2001:db8::8a2e:370:7334"] = ":".join(f"{int(h[i : i + 4], 16):x}" for h in [digits_by_hand("20010db80000000000008a2e03707334", "k", "ip6", 16)] for i in range(0, 32, 4))
    wanted["2001:0db8:0:0:0:8A2E:0370:7334"] = wanted["2001:db8::8a2e:370:7334"]
    d = date_by_hand(date(2024, 2, 29), "k")
    wanted |= {"2024-02-29": d.isoformat(), "29.02.2024": f"{d:%d.%m.%Y}", "29/02/2024": f"{d:%d/%m/%Y}", "02/29/2024": f"{d:%m/%d/%Y}", "2/29/2024": f"{d.month}/{d:%d/%Y}", "2024/02/29": f"{d:%Y/%m/%d}"}
    wanted |= {x: ssn_by_hand(x, "k") for x in ("123-45-6789", "899-99-9999", "001-01-0001", "667-10-1000", "665-10-1000")}
    spaced = " ".join(ibans[0][i : i + 4] for i in range(0, 22, 4))
    same = ["DE89370400440532013001", "XX89370400440532013000", "000-12-3456", "666-00-0000", "900-12-3456", "123-00-6789", "123-45-0000", "30.02.2024", "13/13/2024", "2024/02/30",
            "3782 822463 10006", "12:30:45", "a::b", "std::vector", "fe80::1", "00:1a:2b:3c:4d:5e", "1.2.2024.5", "AKIAshort", "sk-", "v1.2.3", "29.02.1850"]
    texts = [*wanted, *same, *(f"see {x}, or" for x in [*wanted, *same]), spaced, spaced + " IBAN 12", "again " + spaced + "."]
    got = dict(zip(texts, [r.text for r in pii.pseudonymised(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "k").collect()], strict=True))
    for x, y in [*wanted.items(), *((x, x) for x in same)]:
        assert got[x] == y and got[f"see {x}, or"] == f"see {y}, or", (x, y, got[x])
        assert (x == y) == (x in same)
    assert all(mod97(got[x][4:] + got[x][:4]) == 1 for x in ibans)
    moved = " ".join(wanted[ibans[0]][i : i + 4] for i in range(0, 22, 4))
    assert (got[spaced], got[spaced + " IBAN 12"], got["again " + spaced + "."]) == (moved, moved + " IBAN 12", f"again {moved}.")


def card_by_hand(text, key):
    head = digits_by_hand(text[:-1], key, "card")
    return next(head + str(c) for c in range(10) if luhn(head + str(c)))


def test_key_is_in_no_plan(spark):
    frame = spark.createDataFrame([(1, 2, 3, "ssn 123-45-6789")], "`_` int, `a.b` int, `_key` int, text string")
    got = pii.pseudonymised(frame, "a-very-hidden-key")
    assert got.columns == ["_", "a.b", "_key", "text", "n_replaced"]
    assert [tuple(r) for r in got.collect()] == [(1, 2, 3, "ssn " + ssn_by_hand("123-45-6789", "a-very-hidden-key"), 1)]
    assert "very-hidden" not in got._jdf.queryExecution().toString()
    assert pii.pseudonymised(frame.select("text"), "k").columns == ["text", "n_replaced"]
    with pytest.raises(ValueError, match="tessera.pii"):
        pii.pseudonymised(frame)


def test_given_out_numbers_are_permuted(spark):
    frame = spark.sql("SELECT concat_ws('-', lpad(string(600 + id % 90), 3, '0'), '77', lpad(string(id + 1), 4, '0')) AS text FROM range(3000)").where("text NOT LIKE '666-%'")
    out = [r.text for r in pii.pseudonymised(frame, "k").collect()]
    assert len(set(out)) == len(out) == frame.count()
    assert all(re.fullmatch(r"\d{3}-\d{2}-\d{4}", t) and 1 <= int(t[:3]) <= 899 and t[:3] != "666" and t[4:6] != "00" and t[7:] != "0000" for t in out)


def test_pseudonyms_keep_their_format(spark):
    texts = ["card 4417744280351547 and 4417 7442 8035 1547", "not 9807915762804490", "ip 97.51.17.173, 999.1.1.1", "on 2024-02-29 or 2023-02-29",
             "ssn 123-45-6789", "+1 (017) 555-7713", "mail a.b9@mail.example.com", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "again 4417744280351547", None, "", "plain 12 words"]
    got = [r.text for r in pii.pseudonymised(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect()]
    one = re.search(r"\d{16}", got[0])[0]
    assert one != "4417744280351547" and luhn(one) and one in got[8]
    assert re.sub(" ", "", got[0].split(" and ")[1]) == one and re.search(r"\d{4} \d{4} \d{4} \d{4}$", got[0])
    assert got[1] == texts[1] and "999.1.1.1" in got[2] and "97.51.17.173" not in got[2]
    assert all(int(o) < 256 for o in re.search(r"ip ([\d.]+),", got[2])[1].split("."))
    assert "2023-02-29" in got[3] and 1900 <= date.fromisoformat(re.search(r"on (\S+)", got[3])[1]).year <= 2099
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", got[4]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[5])
    assert re.fullmatch(r"mail [a-z0-9]\.[a-z0-9]{2}@mail\.example\.com", got[6]) and re.fullmatch(r'token = "[0-9a-f]{40}"', got[7])
    assert got[9:] == [None, "", "plain 12 words"]
    assert got[4] == "ssn " + ssn_by_hand("123-45-6789", "k")
    assert re.search('"(.*)"', got[7])[1] == digits_by_hand("04dbebab91ab85687d33eeaaf9ac699e1188f962", "k", "secret", 16)


def test_phone_ends_before_the_next_number(spark):
    phones = ["+1 (826) 555-4081", "+44 20 7946 0958", "+49 30 1234 5678", "+7 (495) 123-45-67"]
    behind = ["190.137.223.204", "123-45-6789", "4417 7442 8035 1547", "2024-02-29", "212-555-0123", "12:30", "12.5", "3,50"]
    texts = [*phones, *behind, *[f"{p} {b}" for p in phones for b in behind], *[f"{p} {n}" for p in phones[:2] for n in ("19", "2024", "190.13", "12 34 56")]]
    texts += ["+1 (826) 555-4081-190", "+49 30-1234 5678", "+49 30 123-45-6789", "+1 (8261) 555-4081", "+123 (4567) 8901 2345 6789", "+1 826 555 4081-190.137.223.204"]
    got = dict(zip(texts, [r.text for r in pii.pseudonymised(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "k").collect()], strict=True))
    assert all(got[p] != p for p in phones) and all(got[b] != b for b in behind[:5])
    assert all(got[f"{p} {b}"] == f"{got[p]} {got[b]}" for p in phones for b in behind)
    assert all(got[f"{p} {n}"] == f"{got[p]} {n}" for p in phones[:2] for n in ("19", "2024", "190.13", "12 34 56"))
    # Groups tied to a number stay part of it, also where its format is none of the country's; of too many digits the first go.
    whole = {t: t[: len(re.match(r"\+\d+", t)[0])] for t in texts[-6:-2]}
    assert all(all(g not in got[t][len(c) :] for g in re.findall(r"\d{4}", t[len(c) :])) for t, c in whole.items())
    assert "4567" not in got[texts[-2]] and got[texts[-2]].endswith(" 6789") and "2345 " not in got[texts[-2]]
    assert "555 4081" not in got[texts[-1]] and got[texts[-1]].endswith("-" + got["190.137.223.204"])


def test_secrets_in_either_case_stay_linked(spark):
    low = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    mixed = low[:20].upper() + low[20:]
    frame = spark.createDataFrame([(f"k = {t};",) for t in (low, low.upper(), mixed, "7" * 32, low.upper()[:31], low.upper() + "G")], "text string").coalesce(1)
    rows = pii.pseudonymised(frame, "k").collect()
    got = [r.text[4:-1] for r in rows]
    assert [r.n_replaced for r in rows] == [1, 1, 1, 1, 0, 0] and got[4:] == [low.upper()[:31], low.upper() + "G"]
    assert got[0] == digits_by_hand(low, "k", "secret", 16) and got[1] == got[0].upper()
    assert got[2].lower() == got[0] and got[2] != mixed and re.fullmatch("[0-9A-F]{40}", got[1])
    assert [c for a, c in zip(mixed, got[2], strict=True) if not a.isupper() and c.isupper()] == []
    assert got[3] == digits_by_hand("7" * 32, "k", "secret", 16)


def test_digits_are_permuted(spark):
    for radix, n in ((10, 1), (10, 3), (16, 2)):
        every = [np.base_repr(i, radix).lower().zfill(n) for i in range(radix**n)]
        out = [r.x for r in spark.createDataFrame([(e,) for e in every], "t string").selectExpr(f"{pii.permuted('t', radix, chr(39) + 'k' + chr(39), chr(39) + 'w' + chr(39))} AS x").collect()]
        assert sorted(out) == sorted(every) and out != every


def test_dates_are_permuted(spark):
    frame = spark.sql("SELECT string(date_add(date'1999-01-01', int(id))) AS text FROM range(3000)")
    out = {r.text for r in pii.pseudonymised(frame, "k").collect()}
    assert len(out) == 3000 and all(date.fromisoformat(t) for t in out)


def test_pseudonyms_keep_rows(spark, docs, edge_texts):
    frame = docs(edge_texts)
    got = pii.pseudonymised(frame, "k")
    assert set(got.columns) == {*frame.columns, "n_replaced"}
    assert {(r.doc_id, r.text, r.weight) for r in got.collect()} == {(i, t, "mine") for i, t in enumerate(edge_texts)}
    assert pii.pseudonymised(frame.where("false"), "k").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


# ------------------------------------------------------------ tokens


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [1, 2, 100, 50_000, 2**33, 2**63])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = rng.integers(0, top, n, dtype=np.uint64)
    values[::37] = min(2**62, top * 9)
    data = tokens.encode(values)
    back, used = tokens.decode(memoryview(data))
    assert (back == values).all() and used == len(data)
    for a, b in ((0, n // 2), (n // 3, n), (n // 2, n // 2)):
        assert (tokens.decode(memoryview(data), a, b)[0] == values[a:b]).all()


def test_exceptions_are_few_and_blocks_small():
    rng = np.random.default_rng(1)
    values = rng.integers(1000, 1016, 25_600, dtype=np.uint64)
    values[::100] = 50_000
    assert len(tokens.encode(values)) < 25_600 * 0.75


def test_encoder_equals_the_library():
    encoder = tokens.Encoder(tokens.vocabulary_path())
    fresh = Tokenizer.from_file(tokens.vocabulary_path())
    assert fresh.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rng = random.Random(3)
    texts = ["", " ", "  ", "a", "a b", "a  b", " a", "a ", "\n", "a\n b", "a \nb", "it's I'll", "a\u00a0b", "<|endoftext|> x", "x\r\n y", "end. and, so... no,. ."]
    end = "<|endoftext|>"
    texts += [f"a {end} b", f"{end}a b", f"a b{end}", f"a b {end}", f"a {end}{end} b", f"a {end} {end}", f"word{end}word, more.", end, end * 2, end[:-1] + " b", f" {end}\n"]
    texts += ["".join(rng.choice([*" \n\tab'1!é,.\u3000", end]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    ids, counts = encoder.encode(texts)
    at = 0
    for t, e, n in zip(texts, fresh.encode_batch(texts, add_special_tokens=False), counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == [*e.ids, 0], repr(t)
        at += n
    assert at == len(ids) and [len(x) for x in encoder.encode([])] == [0, 0]


def test_shards(spark, docs, edge_texts, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 50)
    frame = docs([*edge_texts, "a <|endoftext|> b"])
    frame = frame.union(frame.where("doc_id = 7"))
    got = sorted(tokens.encoded(frame).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    rows = sorted((r.doc_id, r.text) for r in frame.collect() if r.text is not None) + [(r.doc_id, "") for r in frame.collect() if r.text is None]
    start = 0
    for r, (key, text) in zip(got, sorted(rows), strict=True):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.encoded(frame.where("false")).count() == 0


def test_shards_of_null_keys(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 4)
    rows = [(None, "a b"), (3, "c"), (None, "d e f"), (-2, "g"), (None, None), (3, "h i")]
    got = sorted(tokens.encoded(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, -2, 3, 3]
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    crc = lambda t: zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(k), crc(t)) for k, t in rows)
    assert all(r.start + r.n_tokens == after.start for r, after in zip(got, got[1:], strict=False))
    docs, counts, ids = tokens.read_shard(tokens.write_shard([None, None, -1, 2**62], [1, 2, 1, 1], np.arange(5)))
    assert (docs.to_pylist(), counts.tolist(), ids.tolist()) == ([None, None, -1, 2**62], [1, 2, 1, 1], [0, 1, 2, 3, 4])


def test_bad_shard():
    with pytest.raises(ValueError):
        tokens.read_shard(b"nope" + bytes(40))


# ------------------------------------------------------------ mixing


def test_mixing_meets_entropy_and_budget(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "big" if i % 10 < 7 else f"s{i % 3}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.drawn(frame).collect()
    assert len(got) == 3000
    total, by = sum(r.n_tokens for r in got), {}
    for r in got:
        by.setdefault(r.source, [r.weight, 0, 0])
        by[r.source][1] += r.n_tokens * r.copies
        by[r.source][2] += r.n_tokens
    entropy = -sum(w * np.log(w) for w, _, _ in by.values())
    assert abs(sum(w for w, _, _ in by.values()) - 1) < 1e-9 and abs(entropy - 0.95 * np.log(4)) < 1e-3
    for w, drawn, _ in by.values():
        assert w * total - 12 <= drawn <= w * total + 1
    assert by["big"][0] < by["big"][2] / total


def test_repetition_limit(spark):
    rows = [(i, "w " * 10, "big" if i else "small") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert max(r.copies for r in mixing.drawn(frame, entropy=1.0, repeats=3.0, budget=1.0).collect()) == 3


def test_mixing_edge_cases(spark, docs, edge_texts):
    frame = docs([(t, "en", s) for t, s in zip(edge_texts, [None, "", "a", "b"] * 4, strict=False)])
    got = mixing.drawn(frame)
    assert got.count() == len(edge_texts)
    assert mixing.mixed(frame).columns == frame.columns
    assert {r.weight for r in mixing.mixed(frame).collect()} == {"mine"}
    assert mixing.drawn(frame.where("false")).count() == 0
    one = docs(["a b", "c d e", "a b"])
    assert {(r.copies, r.weight) for r in mixing.drawn(one).collect()} == {(1, 1.0)}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limits", [{}, {"budget": 0.4}, {"budget": 2.7, "entropy": 1.0, "repeats": 9.0}])
def test_draw_matches_a_sequential_one(spark, docs, monkeypatch, limits):
    """Weights by plain bisection, then texts taken one after the other in the order of the permutations."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 60)
    rng = random.Random(8)
    texts = [("w " * rng.choice([0, 1, 3, 7, 30]), "en", rng.choice(["a", "a", "a", "a", "b", None, ""])) for _ in range(900)] + [(None, "en", "a"), (" ", "en", "empty")]
    frame = docs(texts).withColumns({c: F.lit("mine") for c in ("_k", "_b", "_row", "_turn", "pass", "turn", "block")})
    frame = frame.union(frame.where("doc_id = 5"))
    entropy, repeats, budget = (limits.get(k, d) for k, d in (("entropy", 0.95), ("repeats", 4.0), ("budget", 1.0)))
    keyed = frame.select("doc_id", "source", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")).alias("n"), mixing._order().alias("h")).collect()
    sizes = Counter()
    for r in keyed:
        sizes[r.source] += r.n
    total = sum(sizes.values())
    shares = {s: n / total for s, n in sizes.items() if n}

    def weights(a):
        z = sum(p**a for p in shares.values())
        return {s: p**a / z for s, p in shares.items()}

    def ok(a):
        w = weights(a)
        return -sum(x * np.log(x) for x in w.values()) >= entropy * np.log(len(w)) - 1e-12, max(budget * w[s] / shares[s] for s in w) <= repeats + 1e-12

    def bisected(which):
        if which == 0 and ok(1.0)[0] or which == 1 and not ok(1.0)[1]:
            return 1.0
        if which == 1 and ok(0.0)[1]:
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid)[which] == (which == 0) else (low, mid)
        return low if which == 0 else high

    w = weights(max(bisected(0), bisected(1)))
    copies = {}
    for s in sizes:
        own = [r for r in keyed if r.source == s]
        want = round(budget * w.get(s, 0.0) / shares.get(s, 1.0) * sizes[s]) if sizes[s] else 0
        k = min(mixing.MAX_BLOCKS, -(-sizes[s] // 60) + 1)
        turns = {r.b: r.t for r in spark.range(k).select(F.col("id").alias("b"), F.lit("-" if s is None else "+" + s).alias("_s")).select("b", mixing._turn(F.col("b")).alias("t")).collect()}
        order = sorted({(turns[r.h % k], r.h % k, r.h) for r in own})
        passes = int(budget * w.get(s, 0.0) / shares.get(s, 1.0) + 1e-9) if sizes[s] else 0
        left = want - passes * sizes[s]
        by_hash = Counter()
        for r in own:
            by_hash[r.h] += r.n
        for r in own:
            copies[r.h] = passes
        block_left, open_ = left, True
        for b in dict.fromkeys((t, b) for t, b, _ in order):
            inside = [h for t, x, h in order if (t, x) == b]
            size = sum(by_hash[h] for h in inside)
            if block_left >= max(size, 1):
                for h in inside:
                    copies[h] += 1
                block_left -= size
                continue
            for h in inside:
                if block_left <= 0 or by_hash[h] > block_left:
                    break
                copies[h] += 1
                block_left -= by_hash[h]
            break
    got = mixing.drawn(frame, **limits)
    rows = got.select("doc_id", "n_tokens", mixing._order().alias("h"), *[F.col(f"`{c}`") for c in ("copies", "weight", "_k", "source")]).collect()
    assert len(rows) == len(keyed) and all(r["_k"] == "mine" and abs(r.weight - w.get(r.source, 0.0)) < 1e-7 for r in rows)
    zero = {r.h for r in keyed if not r.n}
    assert {r.doc_id: r.copies for r in rows if r.h not in zero} == {r.doc_id: copies[r.h] for r in keyed if r.h not in zero}
    plan = mixing.scheduled(frame, **limits)
    assert plan.columns == [c for c in frame.columns if c not in ("pass", "turn", "block")] + ["pass", "turn", "block", "place"]
    assert plan.count() == sum(r.copies for r in rows) == mixing.mixed(frame, **limits).count()


def test_many_sources_are_joined_without_a_broadcast(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 3), "big" if i % 2 else f"s{i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = sorted(map(tuple, mixing.drawn(frame).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 3)
    monkeypatch.setattr("tessera.llm.common.HOT_ROWS", 50)
    assert sorted(map(tuple, mixing.drawn(frame).collect())) == wanted


def test_weights_are_the_same_however_sums_are_dealt(spark):
    for terms in ([(0.1,), (0.2,), (0.3,)], [(-31.25,), (1e-9,), (2.0 / 3,)]):
        sums = {spark.createDataFrame(x, "p double").coalesce(1).agg(mixing._total(F.col("p"))).first()[0] for x in (terms, terms[::-1])}
        assert len(sums) == 1 and abs(sums.pop() - sum(x for (x,) in terms)) < 1e-14
    rows = [(i, "w " * (1 + i * i % 37), f"s{i % 211}") for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({(r.source, r.weight, r.copies, r.doc_id) for r in mixing.drawn(frame).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_blocks_are_whole_or_cut_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    rows = [(i, "w " * (1 + i % 5), "a" if i % 4 else "b") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.drawn(frame).collect()
    total = sum(r.n_tokens for r in got)
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert own[0].weight * total - 6 <= sum(r.n_tokens * r.copies for r in own) <= own[0].weight * total + 1


# ------------------------------------------------------------ URLs


def test_url_parts(spark):
    cases = {
        "https://M.Example.NET/en/a?b#c": ("m.example.net", "/en/a"), "http://a.org": ("a.org", ""), "x": ("", ""), None: ("", ""), "": ("", ""),
        "ftp://h/p?q://z": ("h", "/p"), "a://b://c/d": ("b:", "//c/d"), "http://h?x/y": ("h", ""), "://Z/": ("z", "/"),
    }
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.url: (r.host, r.path) for r in urls.judged(frame).collect()}
    assert got == cases


def test_rules(spark):
    cases = {
        "http://a.net/x": ("net/", "block"), "http://net/": ("net/", "block"), "http://a.net": (None, "allow"), "http://m.example.net/en/1": ("example.net/en/", "allow"),
        "http://example.net/fr/": ("net/", "block"), "http://example.com/de/": ("example.com/de/", "block"), "http://notexample.com/de/": (None, "allow"),
        "http://a.org/fr/x": ("org/fr/", "allow"), "http://a.org/en": (None, "allow"), "http://xnet/": (None, "allow"),
    }
    frame = spark.createDataFrame([(i, u, "") for i, u in enumerate(cases)], "page_id long, url string, html string")
    assert {r.url: (r.rule, r.verdict) for r in urls.judged(frame).collect()} == cases


def test_aliases_share_blocks(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.com/1", link.format("http://bad.net/x")), (2, "http://bad.net/x", None), (3, "http://b.com/2", '<meta http-equiv="refresh" content="0; url=http://a.com/1">'),
        (4, "http://c.com/1", "<link href='/2' rel='canonical'>"), (5, "http://c.com/2", link.format("http://d.org/fr/1")), (6, "http://d.org/fr/1", link.format("http://worse.net/")),
        (7, "http://worse.net/", ""), (8, "http://lonely.com/", ""), (9, None, link.format("http://bad.net/x")),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("verdict", F.lit("mine")).withColumn("node", F.lit(1))
    found = urls.judged(frame)
    got = {r.page_id: r.verdict for r in found.collect()}
    # 1, 2, 3 are one group with a block; 4, 5, 6, 7 hold an explicit allow.
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow"}
    assert urls.judged(frame.where("false")).count() == 0
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def plain_node(url):
    at = url.find("://")
    if at < 0:
        return None
    _, host, path, query, _ = urlsplit("http" + url[at:])
    path = urljoin("http://h" + (path or "/"), path or "/")[len("http://h") :]
    return host.lower() + path + ("?" + query if query else "") if host else None


class Tags(HTMLParser):
    def __init__(self):
        super().__init__()
        self.targets = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "link" and "canonical" in (a.get("rel") or "").lower().split():
            self.targets.append(a.get("href"))
        if tag == "meta" and (a.get("http-equiv") or "").lower() == "refresh" and "url=" in (a.get("content") or "").lower():
            self.targets.append(re.split("(?i)url=", a["content"], maxsplit=1)[1].strip("'\""))


def test_links_match_the_standard_library(spark):
    """Targets of every kind, as the parsers of the standard library see them."""
    targets = ["2", "./2", "../z", "../../../up", "/", "/a/b", "/a/./b/../c", "//b.net/p", "//B.Net", "?id=2", "?a=1&amp;b=2", "#top", "", "http://x.org/q?r#s", "HTTPS://X.org", "mailto:a@b.c", "a/b/..", "a/b/.", ". ", "&#47;n&#x2f;m", "x&lt;y", "http:opaque"]
    urls_ = ["http://a.com/d/e?q=1#f", "https://A.com", "http://a.com/d/", "http://a.com/d/../e/f", "http://a.com?x"]
    html = {t: f'<p><LINK data-href="no" rel="alternate CANONICAL"\n href="{t}"/>' for t in targets}
    rows = [(u, h) for u in urls_ for h in html.values()]
    rows += [("http://a.com/1", '<meta content="0; URL=../m" http-equiv=refresh>'), ("http://a.com/1", "<meta http-equiv='Refresh' content='5;url=//c.org/2'>"), ("http://a.com/1", '<!-- <link rel=canonical href=/no> --><link href=/yes rel=canonical><link rel="canonical" href="/also">'),
             ("http://a.com/1", '<link rel="stylesheet" href="/css"><link rel=canonical>'), ("nowhere", html["/"]), (None, html["/"]), ("http://a.com/1", None)]
    wanted = set()
    for u, h in rows:
        parser = Tags()
        parser.feed(re.sub("(?s)<!--.*?-->", "", h or ""))
        for t in parser.targets:
            if u and "://" in u and t is not None and not re.match("(mailto|http:opaque)", t):
                a, b = plain_node(u), plain_node(urljoin(u, t.strip()))
                if a and b and a != b:
                    wanted.add((a, b))
    got = urls.links(spark.createDataFrame(rows, "url string, html string").coalesce(1)).collect()
    assert {(r.a, r.b) for r in got} == wanted and len(got) == len(wanted) > 40


def test_many_rules_and_hot_urls(spark, monkeypatch):
    rows = [(i, "http://m.example.net/en/1" if i % 3 else None if i % 2 else f"http://h{i}.org/fr/{i}", "") for i in range(900)]
    rows += [(1000, "http://a.com/1", '<link rel="canonical" href="//bad.net/x">'), (1001, "http://a.com/1", ""), (1002, "http://bad.net/x", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("mine") for c in ("_group", "_node", "node", "spread", "_row", "host")})
    few = sorted(map(tuple, urls.judged(frame).collect()), key=repr)
    monkeypatch.setattr("tessera.llm.common.HOT_ROWS", 50)
    monkeypatch.setattr(urls, "MAX_RULES", 2)
    many = urls.judged(frame)
    assert sorted(map(tuple, many.collect()), key=repr) == few and len(few) == len(rows)
    assert many.columns == ["page_id", "url", "html", "_group", "_node", "node", "spread", "_row", "host", "path", "rule", "verdict"]
    assert {r.page_id: r.verdict for r in many.where("page_id >= 1000").collect()} == {1000: "block", 1001: "block", 1002: "block"}


def test_pages_keep_their_columns(spark):
    pages = table(spark, DIR, "pages")
    assert urls.judged(pages).columns == [*pages.columns, "host", "path", "rule", "verdict"]
