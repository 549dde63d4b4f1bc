"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are tokenised once, where they are read; only (id, piece, length) rows take part in packing.
Pieces as long as a sequence are sequences of their own.  The rest is dealt by hash into shards of bounded size, and each
shard is solved by several islands: a population of packings, each a list of bins.  Crossover injects
whole well-filled bins of one parent into a copy of the other, bins that now hold a piece twice are dissolved, and the
displaced pieces are exchanged for pieces that fill a bin less well, then best-fit back into the room that is left.  After each epoch islands pass their elite to the
next island of the shard through a table in the shared folder; the best packing of each shard is the result.
"""

from __future__ import annotations

import bisect
import json
import random
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import buffers
from .hashing import pieces as text_pieces
from .staging import staged

#: Entries of each half of a worker's cache.
CACHED = 150_000
#: Displaced pieces that are tried two at a time, at most.
PAIRED = 64
#: Classes of bytes: white space, letters, digits, marks, and bytes for which a chunk is left whole (control characters, the apostrophe,
#: which can join a letter, and whatever is not ASCII; Latin letters of two bytes are told apart where they stand).
_WHITE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.array([_WHITE if b in b" \t\n\r\x0b\x0c" else _ODD if b < 33 or b > 126 or b == 39 else _DIGIT if 48 <= b < 58 else _LETTER if chr(b).isalpha() else _MARK for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)
#: A piece whose ids the model gives; a mark run with `<|`, which can begin a special token, is none.
_PIECE = re.compile(r"[a-zà-öø-ÿß]+|[0-9]|(?!.*<\|)[!-&(-/:-@\[-`{-~]+")
_TOKENIZERS: dict[str, _Tokens] = {}


class _Cache(dict):
    """A dictionary that makes its values and keeps the recently used ones, in two generations of at most CACHED each."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Tokens:
    """Token ids of whole batches of texts.

    The tokenizer drops white space before merging and merges within runs of letters, digits or marks only, so a text's ids are those of
    its lower-cased runs in turn.  Runs are cut in one pass over a batch's bytes, and only distinct ones reach the model.  A chunk between
    white space with any other character goes to the tokenizer whole.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        config = json.loads(vocabulary)
        # Runs are cut only for the pipeline that this is written for; any other tokenizer gets whole texts.
        self.direct = [x["type"] for x in (config.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and config["model"]["type"] == "BPE"
        bytes_seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in bytes_seen]
        self.visible = {b: chr(b) for b in bytes_seen} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.held = _Cache(self._made)

    def raw(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _made(self, piece: bytes) -> bytes:
        text = piece.decode()
        if _PIECE.fullmatch(text):
            ids = [t.id for t in self.model.tokenize(text if text.isascii() else piece.decode("latin-1").translate(self.visible))]
        else:
            ids = self.raw(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def runs(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the runs of all texts in turn, the row of each)."""
        data, off = buffers(texts)
        kind, low = _CLASS[data], _LOWER[data]
        # Letters of two bytes, U+00C0 to U+00FF without the two signs; capitals are 32 below small letters.
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        capital = lead[data[lead + 1] <= 0x9E]
        low[capital + 1] = data[capital + 1] + 32
        inside = kind != _WHITE
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = off[:-1][off[:-1] < len(data)]
        first[heads] = inside[heads]
        chunk = np.flatnonzero(first)
        if not len(chunk):
            return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        odd = kind == _ODD
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        whole = np.zeros(len(chunk), bool)
        whole[np.searchsorted(chunk, np.flatnonzero(odd), "right") - 1] = True
        # A run begins with its chunk, where the class changes, and at every digit; never within a chunk that is left whole.
        start = inside.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        if whole.any():
            size = np.diff(np.append(chunk, len(data)))
            kept = np.repeat(whole, size)
            start[chunk[0] :][kept] = False
            low[chunk[0] :][kept] = data[chunk[0] :][kept]
        start[chunk] = True
        begin = np.flatnonzero(start)
        cuts = np.append(np.cumsum(inside)[begin] - 1, inside.sum()).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(low[inside])])
        return found, np.searchsorted(off, begin, "right") - 1

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by `end_id`, the place where each text begins and the total) of texts without nulls."""
        if not self.direct:
            lists = [self.raw(t) + [end_id] for t in texts.to_pylist()]
            return np.fromiter((i for x in lists for i in x), "<u4"), np.cumsum([0, *map(len, lists)])
        found, row = self.runs(texts)
        coded = found.dictionary_encode()
        made = list(map(self.held.__getitem__, coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat, at, of = np.frombuffer(b"".join(made), "<u4"), np.cumsum(size) - size, coded.indices.to_numpy()
        size, at = size[of], at[of]
        place = np.cumsum(size) - size
        total = np.bincount(row, size, minlength=len(texts)).astype(np.int64)
        begins = np.concatenate(([0], np.cumsum(total + 1)))
        out = np.full(begins[-1], end_id, "<u4")
        turn = np.arange(int(size.sum()))
        out[turn + np.repeat(row, size)] = flat[turn + np.repeat(at - place, size)]
        return out, begins


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each row: its ids and `end_id`, cut only if longer than `length`.

    A null, empty or blank text is one piece of `end_id` alone; a text of any length is tokenised whole.  Rows that repeat an id, and rows
    without one, have pieces of their own.  An empty table gives no rows; other columns are not read.  The vocabulary is read where the
    query is made and travels with the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _TOKENIZERS.get(tokenizer_path) or _TOKENIZERS.setdefault(tokenizer_path, _Tokens(held.value))
        for batch in batches:
            for at, part in text_pieces(batch.column(1)):
                ids, begins = tokens.ids(part, end_id)
                size = np.diff(begins)
                many = -(-size // length)
                row = np.repeat(np.arange(len(part)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * length
                here = np.minimum(length, size[row] - start)
                first = begins[:-1][row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + here).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(here), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(bins: list[list[int]], room: list[int], items: list[int], size: list[int], limit: int) -> None:
    """Put `items`, longest first, each into the bin with the least room that holds it, or into a new bin."""
    at: list[list[int]] = [[] for _ in range(limit + 1)]
    open_ = 0
    for b, r in enumerate(room):
        at[r].append(b)
        open_ |= 1 << r
    for i in sorted(items, key=size.__getitem__, reverse=True):
        n = size[i]
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = at[r].pop()
            if not at[r]:
                open_ ^= 1 << r
        else:
            r, b = limit, len(bins)
            bins.append([])
            room.append(limit)
        bins[b].append(i)
        room[b] = r = r - n
        at[r].append(b)
        open_ |= 1 << r


def fitness(bins: list[list[int]], room: list[int], limit: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (squares of the fill)."""
    return -len(bins), sum((1 - r / limit) ** 2 for r in room)


def exchanged(bins: list[list[int]], room: list[int], items: list[int], size: list[int], rng: random.Random) -> list[int]:
    """Exchange one or two pieces of each bin for one or two of `items` that fill it better; what is left over then.

    Two of `items` are tried together only while they are few, as their pairs are many otherwise.
    """
    out = sorted((size[i], i) for i in items)
    order = list(range(len(bins)))
    rng.shuffle(order)
    for b in order:
        held, best = bins[b], (0, (), ())
        if not room[b] or not out:
            continue
        for x in range(len(held)):
            for y in range(-1, x):
                n = size[held[x]] + (size[held[y]] if y >= 0 else 0)
                at = bisect.bisect_right(out, (n + room[b], 1 << 62)) - 1
                if at >= 0 and out[at][0] - n > best[0]:
                    best = out[at][0] - n, (x, y), (at,)
                low, high = 0, len(out) - 1 if len(out) <= PAIRED else 0
                while low < high:
                    two = out[low][0] + out[high][0] - n
                    if two > room[b]:
                        high -= 1
                        continue
                    if two > best[0]:
                        best = two, (x, y), (high, low)
                    low += 1
        gain, inner, outer = best
        if gain:
            gone, come = [held[x] for x in inner if x >= 0], [out[k][1] for k in outer]
            bins[b] = [i for x, i in enumerate(held) if x not in inner] + come
            for k in outer:
                del out[k]
            for i in gone:
                bisect.insort(out, (size[i], i))
            room[b] -= gain
    return [i for _, i in out]


def refit(bins: list[list[int]], items: list[int], size: list[int], limit: int, rng: random.Random | None = None) -> list[list[int]]:
    """`bins` with `items` put back: exchanged for what they replace well, where a source of chance is given, then best-fit."""
    room = [limit - sum(size[i] for i in x) for x in bins]
    if rng:
        items = exchanged(bins, room, items, size, rng)
    best_fit(bins, room, items, size, limit)
    return bins


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], limit: int, rng: random.Random) -> list[list[int]]:
    """A child of `a` with whole well-filled bins of `b` injected."""
    fill = sorted(range(len(b)), key=lambda j: -sum(size[i] for i in b[j]))
    best = fill[: max(1, len(fill) // 2)]
    inject = [b[j] for j in best if rng.random() < 0.3] or [b[best[0]]]
    held = {i for x in inject for i in x}
    bins, displaced = [list(x) for x in inject], []
    for x in a:
        if held.isdisjoint(x):
            bins.append(list(x))
        else:
            displaced += [i for i in x if i not in held]
    return refit(bins, displaced, size, limit, rng)


def mutate(a: list[list[int]], size: list[int], limit: int, rng: random.Random) -> list[list[int]]:
    """Dissolve some of the emptiest bins and put their pieces back."""
    order = sorted(range(len(a)), key=lambda j: sum(size[i] for i in a[j]) * rng.uniform(0.6, 1))
    gone = set(order[: max(2, len(order) // 20)])
    return refit([list(x) for j, x in enumerate(a) if j not in gone], [i for j in gone for i in a[j]], size, limit, rng)


def evolve(size: list[int], limit: int, start: list[list[list[int]]], seed: int, population: int, generations: int) -> list[list[int]]:
    """The best packing after `generations`; `start` are packings to begin with, best-fit-decreasing is always one.

    The search ends as soon as no packing can have fewer bins.
    """
    rng = random.Random(seed)
    pool = [refit([], list(range(len(size))), size, limit), *start]
    lower = -(-sum(size) // limit)
    while len(pool) < population and min(map(len, pool)) > lower:
        pool.append(mutate(rng.choice(pool), size, limit, rng))

    def key(x: list[list[int]]) -> tuple[int, float]:
        return fitness(x, [limit - sum(size[i] for i in y) for y in x], limit)

    scored = sorted(((key(x), x) for x in pool), key=lambda t: t[0], reverse=True)
    for _ in range(generations):
        if len(scored[0][1]) <= lower:
            break
        a, b = (scored[min(rng.sample(range(len(scored)), min(2, len(scored))))][1] for _ in range(2))
        child = crossover(a, b, size, limit, rng) if a is not b else a
        if a is b or rng.random() < 0.5:
            child = mutate(child, size, limit, rng)
        fit = key(child)
        if all(fit != k for k, _ in scored):
            scored = sorted([*scored, (fit, child)], key=lambda t: t[0], reverse=True)[:population]
    return scored[0][1]


def pack(pieces: DataFrame, limit: int = 2048, shard_rows: int = 8192, islands: int = 2, epochs: int = 2, population: int = 8, generations: int = 40, seed: int = 11) -> DataFrame:
    """`pieces` (id, piece, length, ...) with sequence_id and offset; offsets are gapless from 0.

    Every piece, repeated rows included, gets one place; lengths must be within 1..`limit`.  Shards hold about
    `shard_rows` pieces whatever the number of documents, so no task grows with the input.  A shard that best-fit-decreasing packs into as
    few bins as its lengths allow needs no search.  An empty table gives no rows; other columns are kept (`_row` and the two that are
    added are replaced).
    """
    pieces = pieces.drop("sequence_id", "offset")
    full = F.col("length") == limit
    # A row's number within its task and the task make it unique; the staged copy fixes them.
    rows = staged(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    small = rows.filter(~full).select("_row", "length")
    shards = max(1, -(-small.count() // shard_rows))
    dealt = small.withColumn("shard", F.pmod(F.xxhash64("_row"), shards).cast("int"))
    schema = "shard int, island int, bins int, place array<struct<row:long,bin:int,at:int>>"

    def solve(epoch: int):
        def run(key: tuple, pdf: pd.DataFrame, elite: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_row")
            size, ids = pdf["length"].tolist(), pdf["_row"].tolist()
            index, start = {r: i for i, r in enumerate(ids)}, []
            for place in elite["place"] if len(elite) else ():
                bins: dict[int, list[int]] = {}
                for p in place:
                    bins.setdefault(p["bin"], []).append(index[p["row"]])
                start.append(list(bins.values()))
            best = evolve(size, limit, start, hash((seed, epoch, key[0], key[1])), population, generations)
            place = []
            for b, x in enumerate(best):
                at = 0
                for i in x:
                    place.append({"row": ids[i], "bin": b, "at": at})
                    at += size[i]
            return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "bins": [len(best)], "place": [place]})

        return run

    elites = rows.sparkSession.createDataFrame([], schema)
    own = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    for epoch in range(epochs):
        # Migration: an island also begins with the elite of the island before it.
        moved = elites.unionByName(elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")))
        elites = staged(own.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island")).applyInPandas(solve(epoch), schema), "pack-elites")
    best = elites.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    placed = elites.join(best, ["shard", "island"]).select("shard", F.explode("place").alias("p"))
    placed = placed.select(F.col("p.row").alias("_row"), (F.col("shard").cast("long") * (1 << 20) + F.col("p.bin")).alias("sequence_id"), F.col("p.at").cast("long").alias("offset"))
    own_bin = rows.filter(full).withColumns({"sequence_id": -1 - F.col("_row"), "offset": F.lit(0).cast("long")})
    return rows.filter(~full).join(placed, "_row").unionByName(own_bin).drop("_row")
