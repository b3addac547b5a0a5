"""Word shingles as sorted 64-bit hashes, and min-hash signatures of them."""

from __future__ import annotations

import hashlib

import numpy as np

#: Values of a signature, of 16 bits each.
VALUES = 192
#: Sets up to this size have a signature of true permutations, sets from the other on one of bins; between them, both.
PERMUTED_TO, BINNED_FROM = 640, 400
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20


def _constants(name: str, n: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(f"{name} {i}".encode()).digest()[:8], "little") for i in range(n)], np.uint64)


_BYTES = _constants("byte", 256)
_BASE = 0x9E3779B97F4A7C15
_POSITIONS = (_constants("position", 16) | np.uint64(1)).tolist()
_FACTORS, _SHIFTS = _constants("factor", VALUES) | np.uint64(1), _constants("shift", VALUES)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a chunk."""
    word = ~_SPACE[data]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _cuts(data: bytes) -> list[int]:
    """Places to cut a long text into parts of about CHUNK bytes, between words."""
    cuts = [0]
    while len(data) - cuts[-1] > 2 * CHUNK:
        found = [i for c in b" \t\n\x0b\x0c\r" if (i := data.find(c, cuts[-1] + CHUNK)) >= 0]
        if not found:
            break
        cuts.append(min(found))
    return [*cuts, len(data)]


def _of_words(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, or of the whole if there are fewer; unsorted."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    h = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        h = mix(h * np.uint64(_POSITIONS[i % 16]) + words[i : n - k + 1 + i])
    return h


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: lower-cased A-Z, words between white space, ``size`` words on end."""
    raw = [(t or "").encode().lower() for t in texts]
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def flush() -> None:
        data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
        start, words = _word_hashes(data)
        ends = np.cumsum([len(t) + 1 for t in group])
        at = np.searchsorted(start, np.concatenate(([0], ends)))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            out.append(np.unique(_of_words(words[a:b], size)))

    held = 0
    for t in raw:
        if len(t) > 2 * CHUNK:
            # A word's hash does not depend on where it stands, so that parts of a text can follow on each other.
            if group:
                flush()
                group, held = [], 0
            ends = _cuts(t)
            words = [_word_hashes(np.frombuffer(t, np.uint8)[a:b])[1] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            out.append(np.unique(_of_words(np.concatenate(words), size)))
            continue
        group.append(t)
        held += len(t) + 1
        if held >= CHUNK:
            flush()
            group, held = [], 0
    if group:
        flush()
    return out


def permuted_signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value under each of VALUES permutations."""
    out = np.full(VALUES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(hashes), 512):
        part = (hashes[i : i + 512, None] * _FACTORS + _SHIFTS) >> np.uint64(32)
        np.minimum(out, part.min(axis=0).astype(np.uint32), out=out)
    return out.astype(np.uint16)


def binned_signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the smallest hash of each of VALUES equal ranges, one permutation for all; an empty range has the greatest value."""
    edges = np.arange(VALUES, dtype=np.uint64) * np.uint64((1 << 64) // VALUES)
    at = np.searchsorted(hashes, edges)
    ends = np.append(at[1:], len(hashes))
    first = hashes[np.minimum(at, len(hashes) - 1)]
    return np.where(at < ends, (first >> np.uint64(16)).astype(np.uint16), np.uint16(0xFFFF))


def sketch(signature: np.ndarray) -> np.ndarray:
    """One bit of each value in 64-bit words: of similar sets, as many agree as values do, and half of the others."""
    return np.packbits((signature & np.uint16(1)).astype(np.uint8)).view(">i8").astype(np.int64)
