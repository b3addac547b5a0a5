"""Token ids in binary shards of patched frame-of-reference blocks.

A shard is a byte string: a header, the documents' ids and token counts, an
index of block starts, and the blocks. A block holds 256 values as a minimum, a
bit width that covers most offsets from it, the packed offsets, and a list of
exceptions with the offsets' high bits. Shards are rows of a Parquet table in
the shared folder, so that a lost executor's shard is written again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
MAGIC, BLOCK = b"TPF2", 256
_HEAD = struct.Struct("<QBH")
#: Offsets up to this percentile fit the packed width; larger ones are exceptions.
PERCENTILE = 95
#: Tokens after which a shard is closed, texts of a partition in bytes, and pieces that a worker remembers.
SHARD_TOKENS, PARTITION_BYTES, CACHE = 1_000_000, 24_000_000, 1_200_000
#: Rows and bytes of text that are encoded at once.
ENCODE_ROWS, ENCODE_BYTES = 2048, 10_000_000
#: Pieces whose ids are put together at once.
GATHER = 100_000
#: Most partitions of a write: one row for each is broadcast when reading.
MAX_PARTS = 100_000

# ---------------------------------------------------------------- blocks


def _widths(offsets: np.ndarray, last: int) -> np.ndarray:
    """Bits of each row's offsets at PERCENTILE; the last row counts with its first ``last`` values."""
    at = lambda n: max(-(-n * PERCENTILE // 100) - 1, 0)
    limit = np.partition(offsets, at(BLOCK), axis=1)[:, at(BLOCK)]
    limit[-1] = np.sort(offsets[-1, :last])[at(last)]
    return np.array([x.bit_length() for x in limit.tolist()], np.int64)


def _pack(values: np.ndarray, w: int) -> np.ndarray:
    """Low ``w`` bits of each row's 256 values in 4 * w little-endian 64-bit words; value i starts at bit i * w."""
    columns = np.ascontiguousarray(values.T, np.uint64)
    if w < 64:
        columns = columns & np.uint64((1 << w) - 1)
    out = np.zeros((4 * w, len(values)), np.uint64)
    for i in range(BLOCK if w else 0):
        word, shift = divmod(i * w, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8", copy=False)


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T).astype(np.uint64, copy=False)
    out = np.empty((BLOCK, words.shape[0]), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 64)
        out[i] = columns[word] >> np.uint64(shift)
        if shift + w > 64:
            out[i] |= columns[word + 1] << np.uint64(64 - shift)
    if w < 64:
        out &= np.uint64((1 << w) - 1)
    return out.T


def encode(values: np.ndarray) -> bytes:
    """Blocks of unsigned integers: count, block index, blocks. Any count, also none."""
    size = len(values)
    rows = -(-size // BLOCK)
    narrow = not size or int(values.max()) < 1 << 32
    grid = np.zeros(rows * BLOCK, np.uint32 if narrow else np.uint64)
    grid[:size] = values
    grid[size:] = values[-1] if size else 0
    grid = grid.reshape(rows, BLOCK)
    low = grid.min(axis=1, initial=np.iinfo(grid.dtype).max)
    offsets = grid - low[:, None]
    width = _widths(offsets, size - (rows - 1) * BLOCK) if rows else np.zeros(0, np.int64)
    out: list[bytes] = [b""] * rows
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        part = offsets[at]
        packed = _pack(part, w)
        high = part >> part.dtype.type(w) if w < 8 * part.itemsize else np.zeros_like(part)
        where, place = np.nonzero(high)
        cut = np.searchsorted(where, np.arange(len(at) + 1)).tolist()
        extra, place = high[where, place].astype("<u8"), place.astype("<u1")
        lows = low[at].tolist()
        for i, row in enumerate(at.tolist()):
            x, y = cut[i], cut[i + 1]
            out[row] = _HEAD.pack(lows[i], w, y - x) + packed[i].tobytes() + place[x:y].tobytes() + extra[x:y].tobytes()
    starts = np.concatenate(([0], np.cumsum([len(b) for b in out]))).astype("<u8")
    return struct.pack("<QQ", size, rows) + starts.tobytes() + b"".join(out)


def decode(data: memoryview, first: int = 0, last: int | None = None) -> tuple[np.ndarray, int]:
    """Values [first, last) and the bytes that the whole sequence takes; only the blocks that hold them are unpacked."""
    size, rows = struct.unpack_from("<QQ", data)
    last = size if last is None else last
    starts = np.frombuffer(data, "<u8", rows + 1, 16)
    body = 16 + 8 * (rows + 1)
    used = body + int(starts[-1])
    lo, hi = first // BLOCK, -(-last // BLOCK) if last > first else first // BLOCK
    heads = [(at, *_HEAD.unpack_from(data, at)) for at in (body + starts[lo:hi].astype(np.int64)).tolist()] if hi > lo else []
    out = np.zeros((len(heads), BLOCK), np.uint64)
    width = np.array([h[2] for h in heads], np.int64)
    for w in np.unique(width).tolist():
        rows_of = np.flatnonzero(width == w)
        if w:
            words = [np.frombuffer(data, "<u8", 4 * w, heads[k][0] + _HEAD.size) for k in rows_of.tolist()]
            out[rows_of] = _unpack(np.stack(words), w)
    for k, (at, _, w, odd) in enumerate(heads):
        if odd:
            at += _HEAD.size + 32 * w
            places = np.frombuffer(data, "<u1", odd, at)
            out[k, places] |= np.frombuffer(data, "<u8", odd, at + odd) << np.uint64(w)
    if heads:
        out += np.array([h[1] for h in heads], np.uint64)[:, None]
    return out.reshape(-1)[first - lo * BLOCK : last - lo * BLOCK], used


def write_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A shard: header, documents' ids (as 64-bit patterns; nulls come first, the header has their number) and token counts, and all token ids."""
    nulls = doc_ids.count(None)
    parts = [encode(np.array(doc_ids[nulls:], np.int64).view(np.uint64)), encode(np.array(counts, np.uint64)), encode(ids)]
    return MAGIC + struct.pack("<4Q", nulls, *map(len, parts)) + b"".join(parts)


def read_shard(shard: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    view = memoryview(shard)
    if bytes(view[:4]) != MAGIC:
        raise ValueError("not a token shard")
    nulls, a, b, c = struct.unpack_from("<4Q", view, 4)
    docs, _ = decode(view[36 : 36 + a])
    counts, _ = decode(view[36 + a : 36 + a + b])
    ids, _ = decode(view[36 + a + b : 36 + a + b + c])
    return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(docs.view(np.int64))]), counts.astype(np.int64), ids.astype(np.uint32)


# ---------------------------------------------------------------- tokenizer


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Closing signs: no letter, digit or space among them.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_PACK = [struct.Struct(f"<{n}I").pack for n in range(12)]


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class Encoder:
    """Byte-level BPE by the tokenizers library.

    Its pre-tokenizer always parts a text before a single space between two
    other characters, so pieces between such spaces are encoded once and
    remembered, as an array of pieces and one of ids; the library encodes every
    piece that is not remembered, and as a whole every text in which a space has
    white space beside it or that holds an added token.
    """

    _shared: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Texts of tokens that the library finds before it parts a text.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tails: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        #: Pieces, and the ids of a space and each of them.
        self.pieces = pa.array([], pa.large_string())
        self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The process's encoder of this file."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [_PACK[n](*ids) if (n := len(ids := e.ids)) < len(_PACK) else np.array(ids, "<u4").tobytes() for e in found]

    def _tail(self, end: str) -> bytes:
        if end not in self.tails:
            if len(self.tails) > 1000:
                self.tails = {}
            self.tails[end] = self._plain([end])[0] if end else b""
        return self.tails[end]

    def _model(self, word: str, lead: str = "") -> bytes:
        """Ids of letters, or a space and letters: one unit of the pre-tokenizer, so that the model alone is asked."""
        plain = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.model.tokenize(lead + plain)]
        return _PACK[n](*ids) if (n := len(ids)) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> list[bytes | None]:
        """Ids of a space and each word; None for words that are, or have at an end, white space."""
        out: list[bytes | None] = [None] * len(words)
        other: list[int] = []
        for i, p in enumerate(words):
            if p.isalpha():
                out[i] = self._model(p, "\u0120")
            elif (ids := self._lines(p)) is not None:
                out[i] = ids
            elif p and not p[0].isspace() and not p[-1].isspace():
                other.append(i)
        for i, ids in zip(other, self._plain([" " + words[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def _lines(self, piece: str) -> bytes | None:
        """Ids of a space and words that line ends part, each letters with closing signs; None for other pieces."""
        ids, lead = b"", "\u0120"
        for line in piece.split("\n"):
            word = line.rstrip(_SIGNS)
            if not word.isalpha():
                return None
            ids += (self._tail("\n") if ids else b"") + self._model(word, lead) + self._tail(line[len(word) :])
            lead = ""
        return ids

    def _places(self, flat: pa.Array) -> np.ndarray:
        """Number of each piece among the remembered ones, those that are new learned first; -1 beside white space."""
        if len(self.pieces) > CACHE:
            self._forget()
        at = pc.index_in(flat, value_set=self.pieces)
        missed = at.is_null()
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        new = pc.unique(flat.filter(missed))
        if len(new):
            ids = self._learn(new.to_pylist())
            good = np.array([x is not None for x in ids], bool)
            number = np.where(good, len(self.pieces) + np.cumsum(good) - 1, -1)
            where = np.flatnonzero(missed.to_numpy(zero_copy_only=False))
            place[where] = number[pc.index_in(flat.filter(missed), value_set=new).to_numpy().astype(np.int64)]
            kept = [x for x in ids if x is not None]
            self.pieces = pa.concat_arrays([self.pieces, new.filter(pa.array(good))])
            self.lengths = np.concatenate((self.lengths, np.array([len(x) // 4 for x in kept], np.int64)))
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(kept), "<u4")))
        return place

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, END_ID after each, and the number of each text's ids with it."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        strings = pa.array(texts, pa.large_string())
        parts = pc.split_pattern(strings, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.flatten()
        first, many = bounds[:-1], np.diff(bounds)
        # Letters before closing signs are a unit of their own, and so are those signs.
        stems = pc.utf8_rtrim(flat, characters=_SIGNS)
        signed = pc.and_(pc.not_equal(pc.binary_length(flat), pc.binary_length(stems)), pc.utf8_is_alpha(stems))
        signed = signed.to_numpy(zero_copy_only=False).copy()
        signed[first] = False
        piece = self._places(pc.if_else(pa.array(signed), stems, flat))
        signs = pc.replace_substring_regex(flat.filter(pa.array(signed)), pattern=r"^\pL+", replacement="").dictionary_encode()
        # Heads have no space before them; one that is empty or ends in white space stands beside a space.
        heads = flat.take(pa.array(first)).to_pylist()
        whole = np.array([not h or h[-1].isspace() for h in heads], bool) & (many > 1)
        for token in self.added:
            whole |= pc.match_substring(strings, token).to_numpy(zero_copy_only=False)
        beside = piece < 0
        beside[first] = False
        whole |= np.add.reduceat(beside, first) > 0
        extra = self._plain([t if w else h for t, w, h in zip(texts, whole.tolist(), heads, strict=True)])
        extra += [_PACK[1](END_ID), *(self._tail(t) for t in signs.dictionary.to_pylist())]
        known = len(self.lengths)
        lengths = np.concatenate((self.lengths, [len(x) // 4 for x in extra]))
        values = np.concatenate((self.ids, np.frombuffer(b"".join(extra), "<u4")))
        starts = np.cumsum(lengths) - lengths
        piece[first] = known + np.arange(n)
        # Of a text that is encoded as a whole, only its head stays.
        text = np.repeat(np.arange(n), many)
        dropped = whole[text]
        dropped[first] = False
        nothing = len(lengths)
        piece[dropped] = nothing
        lengths, starts = np.append(lengths, 0), np.append(starts, 0)
        after = np.flatnonzero(signed)
        sign = np.where(dropped[after], nothing, known + n + 1 + signs.indices.to_numpy())
        # Signs follow their letters, the end id follows the text.
        piece = np.insert(piece, np.concatenate((after + 1, bounds[1:])), np.concatenate((sign, np.full(n, known + n))))
        take = lengths[piece]
        out = []
        for low in range(0, len(piece), GATHER):
            p, k = piece[low : low + GATHER], take[low : low + GATHER]
            done = np.cumsum(k)
            out.append(values[np.repeat(starts[p] - (done - k), k) + np.arange(int(done[-1]))])
        begin = bounds[:-1] + np.arange(n) + np.searchsorted(after, first)
        return np.concatenate(out), np.add.reduceat(take, begin)


# ---------------------------------------------------------------- tables


def write(documents: DataFrame, path: str, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """Encode every text and write shards in ascending order of ``key``; the table of shards as read back.

    Rows: part (range of keys), seq (shard in it), first_key, n_docs, n_tokens,
    before (ids of the part's earlier shards), shard. Null texts count as empty: the end id alone. Null keys
    come before all others and stay null; a key is an integer, others fail the cast. Texts of a
    repeated key follow on each other by their hash. An empty table gives no shard. A very long text is
    encoded whole, alone if it has more than ENCODE_BYTES, and makes one shard however long. Other columns are
    neither read nor kept.
    """
    spark = documents.sparkSession
    schema = "part int, seq int, first_key long, n_docs long, n_tokens long, before long, shard binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        encoder = Encoder.of(vocabulary)
        docs: list[int] = []
        counts: list[int] = []
        data: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(data)
            row = [part, seq, docs[0], len(docs), len(ids), before, write_shard(docs, counts, ids)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()], strict=True)],
                names,
            )

        for batch in common.pieces(batches, 1, ENCODE_ROWS, ENCODE_BYTES):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, sizes = encoder.encode([t or "" for t in texts])
            at = 0
            for k, n in zip(keys, sizes.tolist(), strict=True):
                docs.append(k)
                counts.append(n)
                data.append(ids[at : at + n])
                at, held = at + n, held + n
                if held >= SHARD_TOKENS:
                    yield close()
                    seq, before, held = seq + 1, before + held, 0
                    docs, counts, data = [], [], []
            # What is still held must not keep the whole batch alive.
            data = [np.concatenate(data)] if data else []
            pa.default_memory_pool().release_unused()
        if docs:
            yield close()

    common.importable(spark)
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // max(PARTITION_BYTES, -(-size // MAX_PARTS))))
    # Texts of one key may be many: their hashes part them and give them an order.
    rows = documents.select(F.col(key).cast("long").alias(key), "text", F.xxhash64("text").alias("_h"))
    ordered = rows.repartitionByRange(parts, key, "_h").sortWithinPartitions(key, "_h")
    made = ordered.select(key, "text").mapInArrow(shards, schema)
    return common.stored(made, "token-shards", path)


def index(shards: DataFrame) -> DataFrame:
    """(part, start): ids of all parts before, one row for each part, at most about MAX_PARTS."""
    from pyspark.sql import Window

    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("part", F.coalesce(before, F.lit(0)).alias("start"))


def read(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the shards."""
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, shard in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, counts, ids = read_shard(shard.as_py())
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docs, *(pa.array(x, pa.int64()) for x in (start + ends - counts, counts, crc))],
                    [key, "start", "n_tokens", "ids_crc32"],
                )

    common.importable(shards.sparkSession)
    placed = shards.select("part", "before", "shard").join(F.broadcast(index(shards)), "part")
    return placed.select((F.col("start") + F.col("before")).alias("start"), "shard").mapInArrow(documents, schema)


def encoded(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``documents`` to shards in the shared folder and read them back."""
    path = common.scratch_path(documents.sparkSession, "tokens")
    return read(write(documents, path, vocabulary or vocabulary_path()))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_tokens": op5_tokens}
