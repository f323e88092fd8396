"""Words and their hashes of many texts at once, as numpy arrays over the UTF-8 bytes.

Letters A-Z are folded. Bytes from 0x80 on (all letters outside ASCII) count as word bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in groups of about this many bytes (a longer text is a group of its own).
GROUP_BYTES = 1 << 20
#: Words up to this many bytes are hashed together, longer ones singly.
SHORT = 32

_FNV, _SEED = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)

_byte = np.arange(256, dtype=np.uint8)
_upper = (_byte >= 65) & (_byte <= 90)
_alpha = _upper | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
FOLD = np.where(_upper, _byte + 32, _byte).astype(np.uint8)
WORD = _alpha | ((_byte >= 48) & (_byte <= 57))
LETTER = _alpha


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each text starts (one more at the end)."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(column: pa.Array, most: int = GROUP_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and starts of consecutive groups of texts, of up to ``rows`` texts."""
    if not len(column):
        return
    data, at = flat(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        last = last if rows is None else min(last, first + rows)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word. No word crosses from one text to the next."""
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """64-bit hashes of folded words, and of their prefixes of the given lengths (0: shorter)."""
    folded, length = FOLD[data], end - start
    h, cut = np.full(len(start), _SEED), []
    live = np.arange(len(start))
    for k in range(SHORT):
        live = live[length[live] > k]
        if not len(live):
            break
        h[live] = (h[live] ^ folded[start[live] + k]) * _FNV
        if k + 1 in prefixes:
            cut.append(np.zeros(len(start), np.uint64))
            cut[-1][live] = mix(h[live] + np.uint64(k + 1))
    cut += [np.zeros(len(start), np.uint64)] * (len(prefixes) - len(cut))
    for i in np.flatnonzero(length > SHORT):
        h[i] = int.from_bytes(hashlib.blake2b(folded[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h), cut


def shingles(word: np.ndarray, text: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words in a row, and the text of each; a shorter text is one shingle of all its words."""
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[first, len(text)])
    place = np.arange(len(text)) - np.repeat(first, count)
    left = np.repeat(count, count) - place
    full, short = left >= n, (place == 0) & (left < n)
    out = np.zeros(len(word), np.uint64)
    padded = np.r_[word, np.zeros(n, np.uint64)]
    for k in range(n):
        use = full | (short & (k < left))
        out[use] = mix(out[use] + padded[k : k + len(word)][use] + np.uint64(k + 1))
    keep = full | short
    return out[keep], text[keep]
