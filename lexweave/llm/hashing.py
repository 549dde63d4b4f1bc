"""Vectorised word and shingle hashing over Arrow string buffers (no per-word Python objects)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A byte of a word: anything but ASCII white space, control characters and ASCII punctuation.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def pieces(texts: pa.Array | pa.ChunkedArray, limit: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) in runs of whole texts of about `limit` bytes; nulls read as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large_string array without nulls."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of words; a word never crosses two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = WORD_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = off[1:] - 1
    tails = tails[tails >= 0]
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every lower-cased word, row it is in), in order."""
    data, off = buffers(pc.utf8_lower(texts))
    start, end = word_spans(data, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = end - start
    power = np.cumprod(np.full(int(size.max()), _BASE), dtype=np.uint64)
    compact = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=compact[1:])
    place = np.arange(int(size.sum())) - np.repeat(compact, size)
    value = data[WORD_BYTE[data]].astype(np.uint64)
    value += np.uint64(1)
    value *= power[place]
    return mix(np.add.reduceat(value, compact)), np.searchsorted(off, start, "right") - 1


def shingle_counts(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, times) of each text's distinct shingles of `n` words, sorted by row and hash.

    A text of 1 to n-1 words has one shingle of all its words; a text without words has none.
    """
    word, row = word_hashes(texts)
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    heads, sizes = [], []
    count = np.bincount(row, minlength=len(texts))
    if len(word) >= n:
        at = np.flatnonzero(row[: len(word) - n + 1] == row[n - 1 :])
        total = np.zeros(len(at), np.uint64)
        for j in range(n):
            total += word[at + j] * _SHINGLE[j % 5] + np.uint64(j // 5)
        heads.append(row[at])
        sizes.append(mix(total))
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        total = np.full(len(short), 1, np.uint64)
        for j in range(n - 1):
            on = count[short] > j
            total[on] += word[first[short[on]] + j] * _SHINGLE[j % 5] + np.uint64(17 + j)
        heads.append(short)
        sizes.append(mix(total))
    row, h = np.concatenate(heads), np.concatenate(sizes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))
