"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts: one of toxic texts, one
of as many bytes of ordinary texts, both with the same base of further ordinary
text behind them. The base matches what ordinary language has in common, so that
the lengths of a window under the two differ by what only one class has. A window
that is shorter with the toxic dictionary speaks for toxicity. The gains of a
text's windows are turned into a probability by a monotone calibration on labelled
texts that no dictionary holds.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.zstd_text import letters, literal_compressor, windows

#: Most labelled rows of toxic and of ordinary texts that are brought to the driver, and characters of each.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 1200, 4500, 16_000
#: Bytes of a class's dictionary and of the base behind both.
CLASS_BYTES, BASE_BYTES = 800_000, 7_000_000
#: Bytes of a window and of its overlap with the next one; windows of a passage that is judged on its own in a longer text.
WINDOW, OVERLAP, PASSAGE = 32, 8, 512
MIN_MATCH, HASH_LOG = 5, 22
#: A text is called toxic from this probability on.
THRESHOLD = 0.3


@dataclass
class Model:
    #: Dictionaries of both classes, and the base behind them.
    ordinary: bytes
    toxic: bytes
    base: bytes = b""
    #: Ascending evidence, with the probability from there on.
    steps: list[float] = field(default_factory=list)
    chances: list[float] = field(default_factory=list)

    _built = {}

    def _pair(self) -> tuple:
        """Compressors of both dictionaries, built once in each process, which keeps the last ones."""
        if (pair := self.__dict__.get("_made")) is None:
            digest = hashlib.sha256(b"%d|%d|" % (len(self.ordinary), len(self.toxic)) + self.ordinary + self.toxic + self.base).digest()
            if digest not in Model._built:
                Model._built.clear()
                Model._built[digest] = tuple(literal_compressor(x + self.base, MIN_MATCH, HASH_LOG).compress for x in (self.ordinary, self.toxic))
            pair = self.__dict__["_made"] = Model._built[digest]
        return pair

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def gains(self, text: str | None) -> list[int]:
        """Bytes that the toxic dictionary saves against the ordinary one in each window; none without letters."""
        flat = letters(text)
        if not flat or self.toxic == self.ordinary:
            return []
        plain, toxic = self._pair()
        return [len(plain(w)) - len(toxic(w)) for w in windows(f" {flat} ".encode(), WINDOW, OVERLAP)]

    def evidence(self, text: str | None) -> float:
        """The sum of gains by the root of their number, of the whole text or of its strongest passage."""
        found = self.gains(text)
        parts = [found[i : i + PASSAGE] for i in range(0, len(found), PASSAGE)]
        worth = [sum(p) / math.sqrt(len(p)) for p in [found, *parts] if p]
        return max(worth, default=0.0)

    def score(self, text: str | None) -> float:
        at = bisect.bisect_right(self.steps, self.evidence(text)) - 1
        return self.chances[max(at, 0)] if self.chances else 0.0


def isotonic(points: list[tuple[float, int, float]]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators over (evidence, label, weight): the rising step function nearest to the labels."""
    grouped: dict[float, list[float]] = {}
    for x, y, w in points:
        held = grouped.setdefault(x, [0.0, 0.0])
        held[0] += y * w
        held[1] += w
    blocks: list[list[float]] = []
    for x in sorted(grouped):
        blocks.append([x, *grouped[x]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    return [b[0] for b in blocks], [(b[1] + 0.02) / (b[2] + 0.5) for b in blocks]


def _joined(texts: list[str], size: int) -> bytes:
    """Whole texts on end until ``size`` bytes, a space around each."""
    out, n = [], 0
    for t in texts:
        part = f" {t} ".encode()
        if n + len(part) > size:
            break
        out.append(part)
        n += len(part)
    return b"".join(out)


def train(toxic: list[str], ordinary: list[str], weight: float = 1.0) -> Model:
    """Dictionaries and calibration from labelled texts, of which an ordinary one stands for ``weight`` times as many as a toxic one.

    Two of three toxic texts make the toxic dictionary; of four ordinary ones, two
    make the base and one the ordinary dictionary; the others calibrate. No toxic
    example: every text scores 0.
    """
    if not toxic:
        return Model(b"", b"", b"", [0.0], [0.0])
    bad, good = [letters(t) for t in toxic], [letters(t) for t in ordinary]
    of_toxic = _joined([t for i, t in enumerate(bad) if i % 3 != 2 and t], CLASS_BYTES)
    of_ordinary = _joined([t for i, t in enumerate(good) if i % 4 == 2 and t], CLASS_BYTES)
    # As many bytes of both, so that chance matches favour neither.
    size = min(len(of_toxic), len(of_ordinary))
    base = _joined([t for i, t in enumerate(good) if i % 4 < 2 and t], BASE_BYTES)
    model = Model(of_ordinary[:size], of_toxic[:size], base)
    known = [(t, 1, 1.0) for t in toxic[2::3]] + [(t, 0, weight) for t in ordinary[3::4]]
    model.steps, model.chances = isotonic([(model.evidence(t), y, w) for t, y, w in known])
    return model


def sample(documents: DataFrame, labels: DataFrame, key: str, label: str, rows: dict[int, int]) -> tuple[list[tuple[str, int]], float]:
    """At most about ``rows`` labelled texts of each class, chosen by a hash of the key, and what an ordinary one of them weighs.

    A text over SAMPLE_CHARS gives a passage of that length, from a place that its
    hash chooses. The weight brings the sample back to the classes' shares among all labels.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("_y"))
    known = known.where(~common.held_out(F.col(key))).groupBy(key).agg(F.max("_y").alias("_y"))
    texts = documents.select(key, "text").where(F.col("text").isNotNull() & ~common.held_out(F.col(key)))
    counts = {r._y: r["count"] for r in known.groupBy("_y").count().collect()}
    kept = {y: min(1.0, rows[y] / n) for y, n in counts.items()}
    share = F.lit(0.0)
    for y, part in kept.items():
        share = F.when(F.col("_y") == y, part).otherwise(share)
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(8)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = known.where(chance < share)
    begin = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    # About ``rows`` keys of each class: few enough to send to every task, so that no text is shuffled.
    got = texts.join(F.broadcast(chosen), key).select(F.substr("text", begin + 1, F.lit(SAMPLE_CHARS)).alias("text"), "_y", F.xxhash64("text").alias("_h")).collect()
    weight = kept.get(1, 1.0) / kept.get(0, 1.0)
    return [(r.text, r._y) for r in sorted(got, key=lambda r: (r._h, r.text))], weight


def classify(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic",
    toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS,
) -> DataFrame:
    """(key, held_out, score, predicted) of every text.

    Labels are learned from ``labels`` rows outside the held-out fold only; rows
    with other labels than 0 and 1 are ignored, a key labelled twice counts as 1
    if either says so. Null, empty and letterless texts have no evidence and get
    the lowest step's probability; without toxic labels every score is 0. Very long
    texts are scored over all their windows, one text at a time. Equal evidence has
    equal scores, and a score of just THRESHOLD is called toxic. Repeated rows are
    scored one by one; an empty table gives no row; other columns are neither read
    nor kept, so that no name clashes.
    """
    known, weight = sample(documents, labels, key, label, {1: toxic_rows, 0: ordinary_rows})
    model = train([t for t, y in known if y == 1], [t for t, y in known if y == 0], weight)

    def rows_of(keys: list, texts: list) -> dict:
        return {key: keys, "score": [model.score(t) for t in texts]}

    scored = common.arrow_map(documents, rows_of, f"{key} {dict(documents.dtypes)[key]}, score double", key)
    return scored.select(
        key,
        common.held_out(F.col(key)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
