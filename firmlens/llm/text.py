"""Vectorised text helpers for Arrow batches: word hashes, shingle sets, ASCII word lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd base is invertible modulo 2**64, so a word's hash needs only two prefix sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: One odd multiplier for each place in a shingle.
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
CHUNK_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]  # upper and lower case share a code
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        full[0] = 1
        have = _POWERS[name] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    width = np.int64 if large else np.int32
    at = np.frombuffer(offsets, dtype=width, count=len(column) + 1, offset=column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own, so memory follows the longest text."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word (a run of bytes other than ASCII white space) and the first word's index of each row."""
    first, last = int(offsets[0]), int(offsets[-1])
    data = raw[first:last]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = (offsets[1:-1] - first).astype(np.int64)
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * _powers("base", BASE, len(data)), out=sums[1:])
    hashes = (sums[end] - sums[begin]) * _powers("inverse", INVERSE, len(data))[begin]
    return mix(hashes + (end - begin).astype(np.uint64)), np.searchsorted(begin, offsets - first)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles.

    A row with fewer words has one shingle of all its words; a row without words has none.
    """
    for lo, hi in pieces(offsets):
        words, at = word_hashes(raw, offsets[lo : hi + 1])
        n = len(words)
        full = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
        for k in range(width if len(full) else 0):
            full += words[k : k + len(full)] * PLACES[k]
        full = mix(full)
        for row in range(hi - lo):
            a, b = int(at[row]), int(at[row + 1])
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                short = np.uint64(b - a) + (words[a:b] * PLACES[: b - a]).sum(dtype=np.uint64)
                yield mix(np.array([short], dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)


#: Bytes of the words used for phrases: digits, letters, and every byte of a non-ASCII character; A-Z become a-z.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


_LETTER_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def letter_runs(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and non-ASCII characters, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTER_BYTES).split() if text else []
