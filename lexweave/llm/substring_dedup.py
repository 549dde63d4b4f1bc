"""Substring deduplication by hashing of lines and the sentences within them.

A text is cut into units: at line breaks, after sentence ends, where a capitalised word follows one in lower case
without a sentence end, and within a sentence before each word whose hash is the least of the `REACH` words on either side.  The
last rule looks at nothing but the words around the cut, so a passage pasted into the middle of a sentence has units of its own
wherever it stands, except for some nine words at either end.  A unit's digest covers its lower-cased words only.  Digests are grouped over all documents; the earliest occurrence, by document id and then
by place, stays.  A run of units in a document that all occurred earlier and together have at least `min_words`
words is removed.  Shorter repeats stay by default: in a large corpus nearly every short line ("Read more.") occurs somewhere earlier,
and taking them out would cut holes into documents that copy nothing; `min_words=1` removes every repeated unit.

Rows in the two shuffles are digests and places, never texts; units that occur once are mostly kept from the second.  A digest that a
third of all rows hold is reduced map-side for its first occurrence, which is written, and meets its occurrences in an equi-join that adaptive
execution splits.  Digests have 128 bits: among a million million units two different ones are taken for equal with a chance of one in 10 ** 14.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import WORD_BYTE, buffers, mix, pieces, word_hashes, word_spans
from .staging import sieved, staged

#: Words to either side among which the one that starts an inner unit has the least hash; sentences of up to twice as many stay whole.
REACH = 4
_LAST = (1 << 63) - 1
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def inner_starts(word: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which words start a unit within a sentence; `new` marks the first word of each sentence.  Of equal hashes the first is the least."""
    key, sentence = mix(word + np.uint64(77)), np.cumsum(new)
    least = np.ones(len(word), bool)
    for d in range(1, REACH + 1):
        same = sentence[d:] == sentence[:-d]
        least[:d] = least[-d:] = False
        least[d:] &= same & (key[d:] < key[:-d])
        least[:-d] &= same & (key[:-d] <= key[d:])
    return least


def cuts(texts: pa.Array, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, row, words) of every unit with a word, in order; a unit reaches to the next one or the text's end.  `word`: `word_hashes`."""
    data, off = buffers(texts)
    start, end = word_spans(data, off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(off, start, "right") - 1
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    first, follow = data[start], data[np.minimum(start + 1, len(data) - 1)]
    # Capital: A-Z, or the two-byte capitals from U+00C0 to U+00DE and of Cyrillic.
    upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (follow <= 0x9E)) | ((first == 0xD0) & (follow >= 0x81) & (follow <= 0xAF))
    new = np.ones(len(start), bool)
    gap = slice(None, -1)
    blank = _BLANK[data[start[1:] - 1]]
    new[1:] = (row[1:] != row[gap]) | (breaks[start[1:]] > breaks[end[gap]]) | (blank & (stops[start[1:]] > stops[end[gap]])) | (blank & upper[1:] & ~upper[gap])
    at = np.flatnonzero(new | inner_starts(word, new))
    # A unit starts after the white space that follows the one before it.
    ends = np.concatenate(([-1], np.flatnonzero(_BLANK[data] | WORD_BYTE[data])))
    begin = np.maximum(ends[np.searchsorted(ends, start[at]) - 1] + 1, off[row[at]])
    return begin, row[at], np.diff(np.append(at, len(start)))


def unit_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, index in the row, two halves of the digest, words) of every unit with a word."""
    word, _ = word_hashes(texts)
    _, row, words = cuts(texts, word)
    if not len(row):
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64), z.view(np.uint64), z
    at = np.cumsum(words) - words
    place = (np.arange(len(word)) - np.repeat(at, words)).astype(np.uint64)
    h, g = (mix(np.add.reduceat(mix((word ^ np.uint64(key)) + place * np.uint64(0x9E3779B97F4A7C15)), at) + words.astype(np.uint64)) for key in (0, 0x94D049BB133111EB))
    return row, np.arange(len(row)) - np.searchsorted(row, row), h, g, words


def repeated_runs(index: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(first, last) unit of each run of consecutive repeated units with at least `min_words` words."""
    if not len(index):
        return []
    at = np.flatnonzero(np.r_[True, np.diff(index) > 1])
    total = np.add.reduceat(words, at)
    last = np.append(at[1:], len(index)) - 1
    return [(int(index[a]), int(index[b])) for a, b, n in zip(at, last, total) if n >= min_words]


def repeats(docs: DataFrame) -> DataFrame:
    """(rank, key, units): for each document the repeated units (index, words, keeper's id).  `docs`: rank, key, text."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, part in pieces(batch.column(2)):
                row, index, h, g, words = unit_hashes(part)
                row = row + at
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(rank[row]), pa.array(key[row]), pa.array(index.astype(np.int32)), pa.array(words.astype(np.int32))], ["h", "g", "rank", "key", "i", "n"])

    units = docs.mapInArrow(explode, "h long, g long, rank long, key long, i int, n int")
    # Written, so that the join deals its units anew and adaptive execution can split a hot digest.
    first = staged(units.groupBy("h", "g").agg(F.min(F.struct("rank", "key", "i")).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times"), "substring-first")
    later = sieved(units, first, ["h", "g"]).join(first, ["h", "g"]).filter(F.struct("rank", "key", "i") > F.col("first"))
    return later.groupBy("rank", "key").agg(F.sort_array(F.collect_list(F.struct("i", "n", F.col("first.rank").alias("keeper")))).alias("units"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30) -> DataFrame:
    """(id, text, removed, n_removed): one row for each row of `docs`, with the text that stays.

    `removed` lists start and end (code points in the original text) and `keep_id`, the document with the earliest
    occurrence of the span's first unit; the kept parts are joined as they are.  Null texts count as empty; null ids rank last;
    rows equal in id and text count as one document and have the same result; of rows that share an id but not the text, the
    one of the smaller hash ranks first.  A text of any length is cut whole, an empty table gives no rows, other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select(F.coalesce("id", F.lit(_LAST)).alias("rank"), F.xxhash64("id", "text").alias("key"), "text", "id")
    found = repeats(docs.select("rank", "key", "text"))
    joined = docs.join(found, ["rank", "key"], "left").select("id", "text", "units")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = pc.cast(batch.column(1), pa.large_string()), [[] for _ in range(batch.num_rows)]
            kept = texts.to_pylist()
            for i in np.flatnonzero(pc.is_valid(batch.column(2)).to_numpy(zero_copy_only=False)):
                units = batch.column(2)[i].values
                index, words, keeper = (units.field(k).to_numpy() for k in ("i", "n", "keeper"))
                runs = repeated_runs(index, words, min_words)
                if not runs:
                    continue
                begin, _, _ = cuts(texts.slice(i, 1), word_hashes(texts.slice(i, 1))[0])
                data = kept[i].encode()
                ends = np.append(begin[1:], len(data))
                parts, at = [], 0
                for a, b in runs:
                    # Byte offsets become code points by decoding what lies before them.
                    start = len(data[: begin[a]].decode())
                    removed[i].append({"start": start, "end": start + len(data[begin[a] : ends[b]].decode()), "keep_id": int(keeper[np.searchsorted(index, a)])})
                    parts.append(data[at : begin[a]])
                    at = ends[b]
                kept[i] = (b"".join(parts) + data[at:]).decode()
            spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("keep_id", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), spans, pa.array([len(x) for x in removed], pa.int32())], ["id", "text", "removed", "n_removed"])

    return joined.mapInArrow(cut, "id long, text string, removed array<struct<start:long,end:long,keep_id:long>>, n_removed int")
