"""Word and shingle hashes of Arrow text batches, computed on the raw bytes.

Everything here runs in Python workers over NumPy arrays; no Python object is
made for a word.  A word's hash is a polynomial over its (lower-cased) bytes,
normalised to its start and finalised, so equal words hash alike wherever they
stand; a shingle's hash mixes five word hashes in order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

U = np.uint64
N_WORDS = 5
#: Bytes hashed at a time; a longer document is a piece of its own, hashed in parts.
PIECE = 1 << 20
_R = 0x9E3779B97F4A7C15


class _Tables(dict):
    """Tables of this process; they aren't sent along with the code."""

    def __reduce__(self):
        return _Tables, ()


_tables = _Tables()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, byte values, and separators."""
    if "bytes" not in _tables:
        low = np.arange(256)
        low[65:91] += 32
        _tables["bytes"] = mix((low.astype(U) + U(1)) * U(_R))
        sep = np.zeros(256, bool)
        sep[[0x20, 9, 10, 11, 12, 13]] = True
        _tables["sep"] = sep
    if len(_tables.get("pow", ())) <= n:
        with np.errstate(over="ignore"):
            for name, base in (("pow", _R), ("inv", pow(_R, -1, 1 << 64))):
                steps = np.full(max(n + 1, PIECE + 1), base, U)
                steps[0] = 1
                _tables[name] = np.cumprod(steps)
    return _tables["pow"], _tables["inv"], _tables["bytes"], _tables["sep"]


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of whole texts; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + PIECE, "right")) - 1)
        yield row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of the first word of each text (with an end).

    A long text is hashed in parts that end between words, so only the hashes
    of its words (not the arrays over its bytes) grow with it.
    """
    if len(offs) != 2 or len(data) <= 2 * PIECE:
        return _word_hashes(data, offs)
    parts, at, sep = [], 0, _powers(PIECE)[3]
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not sep[data[end - PIECE : end]].any():
            end += PIECE
        if end < len(data):
            end -= int(sep[data[end - PIECE : end]][::-1].argmax())
        parts.append(_word_hashes(data[at:end], np.array([0, len(data[at:end])]))[0])
        at = end
    words = np.concatenate(parts)
    return words, np.array([0, len(words)])


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.empty(0, U), np.zeros(len(offs), np.int64)
    power, inverse, value, sep = _powers(n)
    inside = ~sep[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U)
        np.cumsum(value[data] * power[:n], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ (ends - starts).astype(U)), np.searchsorted(starts, offs).astype(np.int64)


_SALT = [pow(_R, k + 3, 1 << 64) for k in range(N_WORDS)]


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text in word order, and offsets by text.

    A text of one to four words has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    per = np.where(counts >= N_WORDS, counts - N_WORDS + 1, (counts > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(per)])
    # position of each shingle's first word
    at = np.arange(offs[-1]) - np.repeat(offs[:-1], per) + np.repeat(first[:-1], per)
    left = np.repeat(counts, per)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), U)
        if len(at):
            last = len(words) - 1
            for k in range(N_WORDS):
                part = words[np.minimum(at + k, last)] * U(_SALT[k])
                h += part if k == 0 else np.where(left > k, part, U(0))
            h += np.minimum(left, N_WORDS).astype(U)
    return mix(h), offs


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and offsets by text."""
    s, at = shingle_hashes(*word_hashes(data, offs))
    if not len(s):
        return s, at
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            s[a:b].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    starts = at[:-1][at[:-1] < len(s)]
    keep[starts] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], kept[at]


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum (modulo 2^64) of each run of ``values``; an empty run gives 0."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U), np.cumsum(values.astype(U))])
        return total[offs[1:]] - total[offs[:-1]]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
