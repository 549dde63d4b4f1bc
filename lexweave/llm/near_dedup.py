"""Near-duplicate detection: consistent weighted sampling of TF-IDF shingles, banded and verified.

* Weights.  A shingle (five words) weighs its count in the document times ln(1 + 1 / max(df / N, FLOOR)).  Document
  frequencies are exact over all documents wherever they reach FLOOR of them: each task reports shingles in over a
  quarter of FLOOR of its own documents, a sum of these reports bounds every frequency to within a
  quarter of FLOOR of all, so at most (mean shingles a document) / (0.75 FLOOR) candidates are left at any number of documents, and
  these are counted exactly.
* Signatures.  Texts with the same words are collapsed to one representative.  Improved consistent weighted
  sampling (Ioffe, 2010) draws BANDS x ROWS samples (shingle, quantised log weight); equal bands share a bucket.
* Leaders.  Each bucket's best connected member leads, and the others are verified against it by weighted Jaccard similarity.  Buckets
  with more members left than a block holds get further rounds of leaders, among these members only.
* Blocks.  A bucket that still holds several components of links is cut into blocks of bounded size, by component where one fills a
  block.  Two blocks are compared as a whole, by products of their 0/1 matrices of weighted shingles, and give at most one link for two components.
  So every two members of a bucket are compared or known to be in one class, and no table has a row for a pair of members that are not linked.
* Classes are connected components of the links.

Only (band, id) rows and pairs of blocks are grouped.  A bucket's leader comes from a map-side maximum and is written before it is joined,
so that adaptive execution splits a hot bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, pieces, shingle_counts, word_hashes
from .staging import sieved, staged

FLOOR = 0.01
ROWS, BANDS = 3, 14
LEADER_ROUNDS = 3
#: Bytes in a block, of weighted shingles and MEMBER for each member; a document with more is a block of its own.
BLOCK, MEMBER = 6_000_000, 4096
#: Members left in a bucket from which another leader is worth a round.
CROWDED = 2_000
#: Columns of the matrices that are multiplied at once.
COLUMNS = 4096
_FIXED = np.arange(1, 1 + ROWS * BANDS, dtype=np.uint64)
_AGAIN = np.uint64(0xC2B2AE3D27D4EB4F)


def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """65,536 equally likely values of Gamma(2, 1) and their logarithms, by Newton steps on its distribution function."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.sqrt(2 * p) + p * 1.3 - np.log1p(-p) * 0.3
    for _ in range(60):
        f = 1 - (1 + x) * np.exp(-x) - p
        x = np.maximum(x - f / np.maximum(x * np.exp(-x), 1e-300), x / 8)
    return x.astype(np.float32), np.log(x).astype(np.float32)


_TABLES: list[np.ndarray] = []


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(rows that occur, ROWS * BANDS) samples of sorted (row, shingle, weight)."""
    if not _TABLES:
        _TABLES.extend(_gamma_tables())
    r_of, lc_of = _TABLES
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(row)))
    group = np.repeat(np.arange(len(at)), size)
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(at), len(_FIXED)), np.uint64)
    for j, key in enumerate(mix(_FIXED)):
        z = (h ^ key) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
        r = r_of[(z & np.uint64(0xFFFF)).astype(np.uint16)]
        beta = ((z >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + beta)
        la = lc_of[((z >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)] - r * (t - beta + np.float32(1))
        hit = np.flatnonzero(la == np.minimum.reduceat(la, at)[group]) if len(at) else np.zeros(0, np.int64)
        first = hit[np.r_[True, group[hit[1:]] != group[hit[:-1]]]] if len(hit) else hit
        out[:, j] = mix(h[first] + t[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


class Weights:
    """Shingle weights from exact frequencies of frequent shingles."""

    def __init__(self, h: np.ndarray, df: np.ndarray, n: int, floor: float) -> None:
        order = np.argsort(h)
        self.h, self.n, self.floor = h[order], max(n, 1), floor
        self.idf = np.log1p(1 / np.maximum(df[order] / self.n, floor)).astype(np.float64)
        self.rare = math.log1p(1 / floor)

    def __call__(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        idf = np.full(len(h), self.rare)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            idf = np.where(self.h[at] == h, self.idf[at], self.rare)
        return times * idf


def frequent_shingles(docs: DataFrame, words: int, floor: float) -> Weights:
    """Weights over all rows of `docs` (text)."""
    texts = docs.select("text")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kept, held = 0, [], 0
        for batch in batches:
            n += batch.num_rows
            for _, part in pieces(batch.column(0)):
                h = shingle_counts(part, words)[1]
                kept.append((h, np.ones(len(h), np.int64)))
                held += len(h)
                if held > 8_000_000:
                    kept = [summed(kept)]
                    held = len(kept[0][0]) // 2
        h, c = summed(kept)
        on = c > floor / 4 * n
        yield pa.RecordBatch.from_arrays([pa.array(np.append(h[on].view(np.int64), 0)), pa.array(np.append(c[on], n)), pa.array(np.append(np.zeros(on.sum(), bool), True))], ["h", "c", "total"])

    reports = staged(texts.mapInArrow(local, "h long, c long, total boolean"), "near-reports")
    n = reports.filter("total").agg(F.sum("c")).first()[0] or 0
    found = reports.filter("not total").groupBy("h").agg(F.sum("c").alias("c"))
    table = found.filter(F.col("c") >= 0.75 * floor * n).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    table = np.sort(table)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(table), np.int64)
        for batch in batches:
            for _, part in pieces(batch.column(0)):
                h = shingle_counts(part, words)[1]
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                count += np.bincount(at[table[at] == h], minlength=len(table))
        on = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(table[on].view(np.int64)), pa.array(count[on])], ["h", "c"])

    if not len(table):
        return Weights(table, np.zeros(0), n, floor)
    counted = texts.mapInArrow(exact, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= floor * n).toPandas()
    return Weights(counted["h"].to_numpy(np.int64).view(np.uint64), counted["c"].to_numpy(), n, floor)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(c, at) if len(at) else c


def weighted_sets(texts: pa.Array, weights: Weights, words: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted keys, weight of each) of each text: a shingle that occurs k times is there under k keys, so similarity is that of sets."""
    row, h, times = shingle_counts(texts, words)
    idf = weights(h, np.ones(len(h), np.int64))
    at = np.repeat(np.arange(len(h)), times)
    turn = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    key = np.where(turn == 0, h[at], mix(h[at] + turn * _AGAIN))
    row, weight = row[at], idf[at].astype(np.float32)
    if turn.any():
        order = np.lexsort((key, row))
        row, key, weight = row[order], key[order], weight[order]
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    return [(key[a:b], weight[a:b]) for a, b in zip(cut, cut[1:])]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets; 0 if they share nothing."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = float(a[1][b[0][at] == a[0]].sum(dtype=np.float64))
    return shared / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - shared)


def shared_weights(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The weight that each set of one block shares with each of another."""
    out = np.zeros((len(left), len(right)))
    sides = [(np.concatenate([k for k, _ in s]), np.repeat(np.arange(len(s)), [len(k) for k, _ in s])) for s in (left, right)]
    common, first = np.unique(sides[1][0], return_index=True)
    common_weight = np.concatenate([w for _, w in right])[first].astype(np.float64)
    both = np.isin(common, sides[0][0])
    common, common_weight = common[both], common_weight[both]
    if not len(common):
        return out
    placed = []
    for key, of in sides:
        at = np.minimum(np.searchsorted(common, key), len(common) - 1)
        on = common[at] == key
        placed.append((at[on], of[on]))
    for start in range(0, len(common), COLUMNS):
        end = min(start + COLUMNS, len(common))
        tables = []
        for (at, of), n in zip(placed, (len(left), len(right))):
            here = (at >= start) & (at < end)
            table = np.zeros((n, end - start))
            table[of[here], at[here] - start] = 1
            tables.append(table)
        out += (tables[0] * common_weight[start:end]) @ tables[1].T
    return out


def block_links(ids: np.ndarray, component: np.ndarray, side: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Links between members of different components, as few as join what they join.  All of one side: it is compared with itself."""
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1) if (side == 1).any() else x
    total = np.array([w.sum(dtype=np.float64) for _, w in sets])
    shared = shared_weights([sets[i] for i in x], [sets[i] for i in y])
    union = total[x][:, None] + total[y][None, :] - shared
    i, j = np.nonzero((shared >= (threshold - 1e-12) * union) & (shared > 0) & (component[x][:, None] != component[y][None, :]))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found = []
    if len(i):
        i, j = x[i], y[j]
        _, at = np.unique(np.stack([component[i], component[j]]), axis=1, return_index=True)
        for a, b in zip(i[at].tolist(), j[at].tolist()):
            p, q = root(int(component[a])), root(int(component[b]))
            if p != q:
                parent[p] = q
                found.append((min(int(ids[a]), int(ids[b])), max(int(ids[a]), int(ids[b]))))
    return found


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5, floor: float = FLOOR, block: int = BLOCK, crowded: int = CROWDED) -> DataFrame:
    """(id, class_id, class_size, links): one row for each distinct id of `docs`.

    Two documents are linked if their weighted Jaccard similarity is at least `threshold` (or their words are the
    same); a class is a connected component of links, named by its smallest id.  `links` counts the links that were verified, which join
    the class and need not be all there are.  Rows without id are ignored; of rows that share an id the text with the greatest hash counts;
    null and empty texts, and any without words, are in a class of their own; a text of any length is compared whole.  An empty table gives
    no rows, and columns besides the two named are not read.  Words are runs of letters, digits and non-ASCII characters, lower-cased.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    docs = docs.withColumn("pick", F.xxhash64("text"))
    weights = frequent_shingles(docs, words, floor)
    held = spark.sparkContext.broadcast(weights)  # (mean shingles a document) / (0.75 floor) entries at most

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in pieces(batch.column(1)):
                ids = batch.column(0).slice(at, len(part))
                word, of = word_hashes(part)
                place = np.arange(len(word)) - np.searchsorted(of, of)
                a, b = (np.zeros(len(part), np.uint64) for _ in range(2))
                np.add.at(a, of, mix(word + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
                np.add.at(b, of, mix(word ^ mix(place.astype(np.uint64) + np.uint64(99))))
                row, h, times = shingle_counts(part, words)
                bands = [b""] * len(part)
                if len(row):
                    s = signatures(row, h, held.value(h, times)).reshape(-1, BANDS, ROWS)
                    key = np.zeros(s.shape[:2], np.uint64)
                    for j in range(ROWS):
                        key = mix(key + s[:, :, j] + np.arange(BANDS, dtype=np.uint64))
                    for r, k in zip(np.unique(row), key):
                        bands[r] = k.tobytes()
                has = np.bincount(of, minlength=len(part)) > 0
                yield pa.RecordBatch.from_arrays([ids, pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(has), pa.array(bands, pa.binary()), batch.column(2).slice(at, len(part))], ["id", "a", "b", "has", "bands", "pick"])

    signed = staged(docs.mapInArrow(sign, "id long, a long, b long, has boolean, bands binary, pick long"), "near-signed")
    first = signed.groupBy("id").agg(F.max_by(F.struct("a", "b", "has", "bands"), "pick").alias("w")).select("id", "w.*")
    same = first.filter("has").groupBy("a", "b").agg(F.min("id").alias("rep"))
    members = staged(first.join(same, ["a", "b"], "left").select("id", F.coalesce("rep", "id").alias("rep"), F.when(F.coalesce(F.col("id") == F.col("rep"), F.lit(True)), F.col("bands")).alias("bands")), "near-members")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "id"])

    entries = members.filter("length(bands) > 0").select("rep", "bands").mapInArrow(banded, "bucket long, id long")
    shared = staged(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "near-shared")
    entries = staged(entries.join(shared, "bucket").select("bucket", "id", "n"), "near-entries")
    asked = entries.select("id").distinct()
    asked = sieved(docs, asked, ["id"]).join(asked, "id").groupBy("id").agg(F.max_by("text", "pick").alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in pieces(batch.column(1)):
                sets = weighted_sets(part, held.value, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([k.tobytes() for k, _ in sets], pa.binary()), pa.array([w.tobytes() for _, w in sets], pa.binary())], ["id", "keys", "weights"])

    sets = staged(asked.mapInArrow(weigh, "id long, keys binary, weights binary"), "near-sets")
    links, classes = _linked(entries, sets, members.select(F.col("rep").alias("id")), threshold, block, crowded)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = members.select("id", "rep").join(classes.withColumnRenamed("id", "rep"), "rep").join(degree, "rep", "left")
    size = staged(out.groupBy("component").agg(F.count("*").alias("class_size")), "near-sizes")
    return out.join(size, "component").select("id", F.col("component").alias("class_id"), "class_size", F.coalesce("links", F.lit(0)).alias("links"))


def _set(keys: pa.Scalar, weights: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(weights.as_buffer(), np.float32)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs that are links."""
    side = lambda n: sets.select(F.col("id").alias(n), F.col("keys").alias(f"k{n}"), F.col("weights").alias(f"w{n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(_set(ka, wa), _set(kb, wb)) >= threshold - 1e-12 for ka, wa, kb, wb in zip(*batch.columns[2:])]
            on = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], ["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "wa", "kb", "wb")
    return staged(joined.mapInArrow(run, "a long, b long"), "near-verified")


def _linked(entries: DataFrame, sets: DataFrame, nodes: DataFrame, threshold: float, block: int, crowded: int) -> tuple[DataFrame, DataFrame]:
    """Links (a < b) and the components (id, component) that they make of `nodes`."""
    # The best connected member leads: an original shares more buckets with its copies than they share with each other.
    crowd = entries.groupBy("id").agg(F.sum("n").alias("crowd"))
    ranked = staged(entries.join(crowd, "id").select("bucket", "id", "n", "crowd"), "near-ranked")
    alone = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    open_, leads, links, parts = ranked, None, None, None
    for _ in range(LEADER_ROUNDS):
        lead = open_.groupBy("bucket").agg(F.max(F.struct("crowd", (-F.col("id")).alias("neg"))).alias("x"))
        lead = staged(lead.select("bucket", (-F.col("x.neg")).alias("lead")), "near-leads")
        pairs = open_.join(lead, "bucket").filter("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        fresh = _verified(pairs, sets, threshold)
        links, leads = (fresh, lead) if links is None else (links.unionByName(fresh), leads.unionByName(lead))
        parts = staged(components(links.unionByName(alone)), "near-parts")
        marked = ranked.filter("n > 2").join(parts, "id")
        closed = staged(leads.join(parts.withColumnRenamed("id", "lead"), "lead").select("bucket", "component").distinct(), "near-closed")
        left = marked.join(closed, ["bucket", "component"], "left_anti").select("bucket", "id", "n", "crowd")
        many = staged(left.groupBy("bucket").agg(F.count("*").alias("k")).filter(F.col("k") > crowded).select("bucket"), "near-many")
        if many.isEmpty():
            break
        open_ = staged(left.join(many, "bucket", "left_semi"), "near-open")
    fresh = _blocks(marked.select("bucket", "id", "component"), sets, threshold, block)
    last = components(fresh.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = parts.join(last.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left")
    return staged(links.unionByName(fresh.select("a", "b")), "near-links"), staged(merged.select("id", F.coalesce("whole", "component").alias("component")), "near-classes")


def _blocks(marked: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b, ca, cb): links between the components that share a bucket, with the components."""
    mixed = staged(marked.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket"), "near-mixed")
    rows = marked.join(mixed, "bucket").join(sets.select("id", (F.length("keys") * 3 / 2 + MEMBER).alias("size")), "id")
    rows = staged(rows.select("bucket", "id", "component", "size"), "near-rows")
    # A component that fills a block has blocks of its own, which are not compared with each other; the others share blocks.
    filled = rows.groupBy("bucket", "component").agg(F.sum("size").alias("size")).withColumn("own", F.when(F.col("size") >= block, F.col("component")))
    filled = staged(filled, "near-filled")
    cuts = filled.groupBy("bucket", "own").agg(F.ceil(F.sum("size") / block).cast("int").alias("cuts"))
    cuts = staged(cuts.withColumn("name", F.coalesce(F.col("own").cast("string"), F.lit("-"))).select("bucket", "own", "name", "cuts"), "near-cuts")
    blocks = cuts.select("bucket", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: F.concat_ws(" ", "name", i.cast("string")))).alias("block"))
    x, y = (blocks.select("bucket", F.col("own").alias(f"own{n}"), F.col("block").alias(n)) for n in "xy")
    pairs = x.join(y, "bucket").filter((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("ownx") == F.col("owny"), F.lit(False)))
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side"))))
    sides = sides.otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side"))))
    sides = pairs.select("bucket", "x", "y", F.explode(sides).alias("s")).select("bucket", "x", "y", "s.*")
    of = rows.join(filled.select("bucket", "component", "own"), ["bucket", "component"]).withColumn("name", F.coalesce(F.col("own").cast("string"), F.lit("-")))
    of = of.join(cuts.select("bucket", "name", "cuts"), ["bucket", "name"])
    of = of.select("bucket", "id", "component", F.concat_ws(" ", "name", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("string")).alias("block"))
    met = of.join(sides, ["bucket", "block"]).select("bucket", "x", "y", "side", "id", "component").join(sets, "id")
    met = met.select("bucket", "x", "y", "side", "id", "component", "keys", "weights").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def linked() -> pa.RecordBatch:
            side, ids, component = (np.array([r[k] for r in held], np.int64) for k in range(3))
            part = dict(zip(ids.tolist(), component.tolist()))
            found = block_links(ids, component, side, [(np.frombuffer(r[3], np.uint64), np.frombuffer(r[4], np.float32)) for r in held], threshold)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([a for a, _ in found], [b for _, b in found], [part[a] for a, _ in found], [part[b] for _, b in found])], ["a", "b", "ca", "cb"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != last:
                    if held:
                        yield linked()
                    last, held = row[:3], []
                held.append(row[3:])
        if held:
            yield linked()

    return staged(met.mapInArrow(run, "a long, b long, ca long, cb long"), "near-blocks")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each class, that of the smallest id; rows without id stay; columns unchanged.

    Nulls, empty tables and repeated rows: as `near_classes`; of rows that share the smallest id all stay.
    """
    gone = near_classes(docs, id_col, text_col, **options).filter("id <> class_id").select(F.col("id").alias("_near_id"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_near_id"], "left_anti")
