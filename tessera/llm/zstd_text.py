"""Text as zstandard sees it: normalisation, windows and raw-content dictionaries."""

from __future__ import annotations

import re

import zstandard

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased letters with one space between runs; empty for null or for a text without letters."""
    flat = _OTHER.sub(" ", (text or "").lower()).strip()
    return flat if any(map(str.isalpha, flat)) else ""


def windows(data: bytes, size: int, overlap: int = 0) -> list[bytes]:
    """All of ``data`` in windows of ``size`` bytes, each starting ``overlap`` bytes before the last one's end."""
    step = size - overlap
    return [data[i : i + size] for i in range(0, max(len(data) - overlap, 1), step)]


def literal_compressor(content: bytes, min_match: int = 6, hash_log: int = 16) -> zstandard.ZstdCompressor:
    """Against ``content``, with literals stored as they are: a window's length then depends on its matches alone.

    Of equal places in ``content`` the last counts. Dictionaries of megabytes need a larger ``hash_log``.
    """
    chosen = zstandard.ZstdCompressionParameters(
        window_log=max(17, len(content).bit_length()), chain_log=hash_log, hash_log=hash_log, search_log=5, min_match=min_match,
        target_length=1, strategy=zstandard.STRATEGY_FAST, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=chosen)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=chosen)
