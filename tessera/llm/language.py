"""Language identification by compression.

Each language has a raw-content zstandard dictionary, its own labelled text. A
text belongs to the language whose dictionary makes it shortest; a narrow margin
over the second is reported as a rejection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.zstd_text import letters, literal_compressor, windows

#: Bytes of a language's dictionary and of all dictionaries together, and characters of a labelled text that go into one.
DICT_BYTES, TOTAL_BYTES, ROW_CHARS = 60_000, 16_000_000, 8_000
WINDOW, MIN_MATCH, HASH_LOG = 256, 5, 17
#: Shares of the length below which the best language is not trusted.
MARGIN = 0.004


def profiles(documents: DataFrame, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content by language, the most frequent first, from a bounded hash sample of the labelled rows outside the held-out fold.

    All labelled rows are counted; about three times ``dict_bytes`` of each language
    reach the driver, at least one text. A text over ROW_CHARS gives a passage of
    that length, from a place that its hash chooses, so that no language is lost. Of
    very many languages each has a smaller dictionary, TOTAL_BYTES together.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")))
    begin = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - ROW_CHARS, F.lit(0)) + 1).cast("int")
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    known = known.select("lang", F.substr("text", begin + 1, F.lit(ROW_CHARS)).alias("text"), chance.alias("chance"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min("chance").alias("least"))
    found = counts.orderBy(F.desc("n"), "lang").collect()
    if not found:
        return {}
    bound = max(1000, min(dict_bytes, TOTAL_BYTES // len(found)))
    shares = documents.sparkSession.createDataFrame([(r.lang, max(r.least, min(1.0, 3 * bound / max(1, r.size)))) for r in found], "lang string, share double")
    got = known.join(F.broadcast(shares), "lang").where("chance <= share").select("lang", "text", "chance").collect()
    texts: dict[str, list[bytes]] = {r.lang: [] for r in found}
    sizes = dict.fromkeys(texts, 0)
    for r in sorted(got, key=lambda r: (r.chance, r.text)):
        if (flat := letters(r.text)) and sizes[r.lang] < bound:
            texts[r.lang].append(f" {flat} ".encode())
            sizes[r.lang] += len(texts[r.lang][-1])
    return {lang: b"".join(parts) for lang, parts in texts.items() if parts}


class Classifier:
    """Predicts (language, score, margin) of a text; compressors are built once in each process."""

    def __init__(self, content: dict[str, bytes]):
        self.content, self.made = content, None

    def __getstate__(self) -> dict:
        return {"content": self.content, "made": None}

    def predict(self, text: str | None) -> tuple[str, float, float]:
        flat = letters(text)
        if not flat or not self.content:
            return "und", 0.0, 0.0
        if self.made is None:
            self.made = [(lang, literal_compressor(c, MIN_MATCH, HASH_LOG).compress) for lang, c in self.content.items()]
        # In short windows little is matched within the text itself, which tells no language from another.
        parts = windows(f" {flat} ".encode(), WINDOW)
        sizes = sorted((sum(len(press(w)) for w in parts), i) for i, (_, press) in enumerate(self.made))
        lang = self.made[sizes[0][1]][0]
        if len(sizes) == 1:
            return lang, 1.0, 1.0
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return lang, margin / (margin + MARGIN), margin


def identify(documents: DataFrame, content: dict[str, bytes], key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, margin, rejected) of every text.

    Null texts and texts without a letter are ``und`` with score 0, and so are
    all texts if no language was learned. Ties go to the first language of ``content``.
    Very long texts are encoded whole, window by window. Repeated rows are judged one
    by one; an empty table gives no row; other columns are neither read nor kept, so
    that no name clashes.
    """
    model = Classifier(content)

    def rows(keys: list, texts: list) -> dict:
        found = [model.predict(t) for t in texts]
        return {
            key: keys,
            "lang_pred": [f[0] for f in found],
            "score": [f[1] for f in found],
            "margin": [f[2] for f in found],
            "rejected": [f[2] < MARGIN for f in found],
        }

    kind = dict(documents.dtypes)[key]
    return common.arrow_map(
        documents, rows, f"{key} {kind}, lang_pred string, score double, margin double, rejected boolean", key
    )


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    found = identify(documents, profiles(documents))
    return found.select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


QUERIES = {"op1_language": op1_language}
