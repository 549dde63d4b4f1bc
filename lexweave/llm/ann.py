"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, shifted, and ordered along Hilbert curves, each with a projection and a shift of its own.
Spark range-partitions and sorts each ordering; sorted rows become blocks, and a query is compared with
the blocks within a window of its place on each curve.  What the windows find is merged and ranked by the
exact inner product.

How many curves and how wide a window the data need is measured, in time linear in the table: for PROBES queries the
true neighbours are found, the places of both on every curve are counted, and the cheapest pair that would have held
PROBE_RECALL of the neighbours is taken.  Where neighbours are near on a projection the windows are
narrow; on vectors without structure (independent directions) no projection helps and they widen towards the
table, which is then a scan of a stated query set in blocks.

Equal vectors are one point with its smallest ids, so a vector that a third of the rows hold weighs as one.  Vectors of
any length of norm take one more coordinate, which turns the largest inner product into the least distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

CURVES, DIMENSIONS, LEVELS = 4, 6, 10
BLOCK = 4096
PROBES, PROBE_RECALL = 96, 0.97


def hilbert(x: np.ndarray, bits: int = LEVELS) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows, dimensions), each below 2 ** bits (Skilling's transform)."""
    x = [c.astype(np.int64) for c in x.T]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0]) ^ t
            x[i] = x[i] ^ t if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            place = place << 1 | ((c ^ t) >> b & 1)
    return place


class Curves:
    """Projections and shifts, fixed by the seed and the vectors' dimension."""

    def __init__(self, dim: int, largest: float, seed: int = 23) -> None:
        rng = np.random.default_rng(seed)
        self.dim, self.largest = dim, largest
        self.project = rng.standard_normal((CURVES, dim + 1, DIMENSIONS))
        self.shift = rng.uniform(0, 0.5, (CURVES, DIMENSIONS))

    def places(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(rows, CURVES) keys.  Candidates take the coordinate that completes their norm to the largest, queries 0."""
        v = vectors / self.largest
        norm = np.linalg.norm(v, axis=1)
        if query:
            v = v / norm[:, None]
            extra = np.zeros(len(v))
        else:
            extra = np.sqrt(np.maximum(0, 1 - norm * norm))
        v = np.column_stack([v, extra])
        out = np.empty((len(v), CURVES), np.int64)
        for c in range(CURVES):
            # A logistic curve in place of the normal distribution spreads the coordinates evenly enough.
            even = 1 / (1 + np.exp(-1.702 * np.clip(v @ self.project[c], -30, 30)))
            out[:, c] = hilbert(np.minimum((even / 2 + self.shift[c]) * (1 << LEVELS), (1 << LEVELS) - 1).astype(np.int64))
        return out


def valid(vector: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(wide, lambda x: x != 0)


def matrix(rows: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), np.float64).reshape(-1, dim)


def points(vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """(vector, ids): distinct vectors as bytes with their k + 1 smallest ids (one may be the query's own)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) + 0.0
            for key, v in zip(batch.column(0).to_pylist(), flat):
                held.setdefault(v.tobytes(), []).append(key)
                if len(ids := held[v.tobytes()]) > 4 * k:
                    ids[:] = sorted(ids)[: k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(x)[: k + 1] for x in held.values()], pa.list_(pa.int64()))], ["vector", "ids"])

    merged = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")
    found = vectors.mapInArrow(local, "vector binary, ids array<long>")
    return found.groupBy("vector").agg(merged)


def encoded(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, vector) with the vector as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in flat], pa.binary())], ["id", "vector"])

    return vectors.select("id", "v").mapInArrow(run, "id long, vector binary")


def best(score: np.ndarray, ids: list[np.ndarray], own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of points and the ids they stand for, ties to the smaller id."""
    at = np.flatnonzero(score >= np.partition(score, -(k + 1))[-(k + 1)]) if len(score) > k + 1 else np.arange(len(score))
    key = np.concatenate([ids[i] for i in at]) if len(at) else np.zeros(0, np.int64)
    value = np.repeat(score[at], [len(ids[i]) for i in at]) if len(at) else np.zeros(0)
    on = key != own
    key, value = key[on], value[on]
    order = np.lexsort((key, -value))[:k]
    return key[order], value[order]


def merge(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    key, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((key, -value))
    key, value = key[order], value[order]
    _, first = np.unique(key, return_index=True)
    first = np.sort(first)[:k]
    return key[first], value[first]


def calibrated(cands: DataFrame, queries: DataFrame, curves: Curves, k: int) -> tuple[int, int, int]:
    """(curves to use, half-width of the window in points, number of points)."""
    dim = curves.dim
    probes = queries.orderBy(F.xxhash64("id"), "id").limit(PROBES).toPandas()
    q = np.frombuffer(b"".join(probes["vector"]), np.float64).reshape(-1, dim)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            v = matrix(batch.column(0), dim)
            s = q @ v.T
            low = -np.inf if len(v) < 2 else s.min()
            for i in range(len(q)):  # a probe's own point does not count
                alike = np.flatnonzero(v[:, 0] == q[i, 0])
                s[i, alike[(v[alike] == q[i]).all(1)]] = low
            top = np.argsort(-s, axis=1)[:, :k]
            held.append((np.take_along_axis(s, top, 1), curves.places(v, False)[top]))
            if len(held) > 8:
                held = [_joined(held, k)]
        if held:
            s, place = _joined(held, k)
            n = s.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(s.ravel()), *(pa.array(place[:, :, c].ravel()) for c in range(CURVES))], ["q", "s", *(f"p{c}" for c in range(CURVES))])

    fields = ", ".join(f"p{c} long" for c in range(CURVES))
    near = cands.select("vector").mapInArrow(nearest, f"q long, s double, {fields}")
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).filter(F.col("rn") <= k).toPandas()
    own = curves.places(q, True)
    probe = [np.sort(np.concatenate([own[:, c], near[f"p{c}"].to_numpy()])) for c in range(CURVES)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = [np.zeros(len(p) + 1, np.int64) for p in probe]
        for batch in batches:
            place = curves.places(matrix(batch.column(0), dim), False)
            for c in range(CURVES):
                below[c] += np.bincount(np.searchsorted(probe[c], place[:, c], "right"), minlength=len(probe[c]) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(CURVES), [len(b) for b in below])), pa.array(np.concatenate([np.arange(len(b)) for b in below])), pa.array(np.concatenate(below))], ["c", "at", "n"])

    counts = cands.select("vector").mapInArrow(count, "c long, at long, n long").groupBy("c", "at").agg(F.sum("n").alias("n")).toPandas()
    n = int(counts.loc[counts["c"] == 0, "n"].sum())
    away = []
    for c in range(CURVES):
        rank = np.cumsum(counts[counts["c"] == c].sort_values("at")["n"].to_numpy())
        of = lambda place, c=c, rank=rank: rank[np.searchsorted(probe[c], place)]
        away.append(np.abs(of(near[f"p{c}"].to_numpy()) - of(own[near["q"].to_numpy(), c])))
    costs = []
    for m in range(1, CURVES + 1):
        wide = int(np.quantile(np.min(away[:m], axis=0), PROBE_RECALL)) + 1 if len(near) else 1
        costs.append((m * min(2 * wide, n), m, wide))
    _, m, wide = min(costs)
    return m, wide, n


def _joined(held: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    s, place = np.concatenate([h[0] for h in held], 1), np.concatenate([h[1] for h in held], 1)
    top = np.argsort(-s, axis=1)[:, :k]
    return np.take_along_axis(s, top, 1), np.take_along_axis(place, top[:, :, None], 1)


def ordering(cands: DataFrame, queries: DataFrame, curves: Curves, curve: int, block: int) -> DataFrame:
    """Blocks of one sorted ordering: (curve, part, i, n, vectors, ids, query_ids, query_vectors)."""
    dim = curves.dim

    def place(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = curves.places(matrix(batch.column(0), dim), query)[:, curve]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1), batch.column(2)], ["place", "vector", "ids", "query"])

        return run

    schema = "place long, vector binary, ids array<long>, query long"
    rows = cands.select("vector", "ids", F.lit(None).cast("long").alias("query")).mapInArrow(place(False), schema)
    rows = rows.unionByName(queries.select("vector", F.lit(None).cast("array<long>").alias("ids"), F.col("id").alias("query")).mapInArrow(place(True), schema))
    n = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "place", F.xxhash64("vector")).sortWithinPartitions("place", F.xxhash64("vector")).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, part, v, ids, qv, qid = 0, None, [], [], [], []

        def made() -> pa.RecordBatch:
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            cols = [[curve], [part], [i], [len(v)], [b"".join(v)], [flat.astype(np.int64).tobytes()], [np.array([len(x) for x in ids], np.int32).tobytes()], [np.array(qid, np.int64).tobytes()], [b"".join(qv)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5))], ["curve", "part", "i", "n", "vectors", "ids", "sizes", "query_ids", "query_vectors"])

        for batch in batches:
            for _, vector, own, query, p in zip(*(c.to_pylist() for c in batch.columns)):
                part = p
                if query is None:
                    v.append(vector)
                    ids.append(own)
                else:
                    qid.append(query)
                    qv.append(vector)
                if len(v) >= block or len(qid) >= block:
                    yield made()
                    i, v, ids, qv, qid = i + 1, [], [], [], []
        if v or qid:
            yield made()

    return ranged.mapInArrow(cut, "curve int, part int, i int, n long, vectors binary, ids binary, sizes binary, query_ids binary, query_vectors binary")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves_used: int | None = None, window: int | None = None, most_in_block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates found with the largest inner product, nearest first, ties to the smaller id.

    Candidates are all rows of `vectors` but the query's own id.  Null, empty and zero vectors, vectors with a null or
    non-finite component, rows without id, and vectors of another than the most frequent dimension (ties: the larger) take
    no part.  Rows that repeat an id and a vector count once.  A query without other candidates returns no rows; an empty table gives none;
    other columns are not read.  `curves_used` and `window` (points to either side) are measured unless both are given.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    vectors, queries = (x.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & valid(F.col("v"))) for x in (vectors, queries))
    dims = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("sq")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    dim = dims[0]["d"]
    curves = Curves(dim, float(np.sqrt(dims[0]["sq"])) or 1.0)
    raw = F.size("v") == dim
    cands = staged(points(vectors.filter(raw), dim, k), "ann-points")
    asked = staged(encoded(queries.filter(raw), dim).distinct(), "ann-queries")
    m, wide = (curves_used, window) if curves_used and window else calibrated(cands, asked, curves, k)[:2]
    block = int(min(most_in_block, max(256, wide // 4)))
    blocks = None
    for c in range(m):
        one = ordering(cands, asked, curves, c, block)
        blocks = one if blocks is None else blocks.unionByName(one)
    blocks = staged(blocks, "ann-blocks")
    order = Window.partitionBy("curve").orderBy("part", "i")
    begins = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slim = staged(blocks.select("curve", "part", "i", "n", (F.length("query_ids") > 0).alias("asks")).withColumn("begin", begins).withColumn("end", F.col("begin") + F.col("n")), "ann-slim")
    # Targets are the blocks that hold any point within the window of the block's queries; both sides meet in cells of the order, each of
    # which few blocks touch.
    cell = max(wide, block)
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))).alias("cell")
    low, high = F.col("begin") - wide, F.col("end") + wide
    from_ = slim.filter("asks").select("curve", "part", "i", low.alias("low"), high.alias("high"), cells(low, high))
    to = slim.filter("n > 0").select("curve", F.col("part").alias("tp"), F.col("i").alias("ti"), "begin", "end", cells(F.col("begin"), F.col("end") - 1))
    pairs = from_.join(to, ["curve", "cell"]).filter("begin < high and end > low").select("curve", "part", "i", "tp", "ti").distinct()
    sides = blocks.filter(F.length("query_ids") > 0).select("curve", "part", "i", "query_ids", "query_vectors").join(pairs, ["curve", "part", "i"]).select("curve", F.col("tp").alias("part"), F.col("ti").alias("i"), "query_ids", "query_vectors")
    met = sides.join(blocks.select("curve", "part", "i", "vectors", "ids", "sizes"), ["curve", "part", "i"]).select("query_ids", "query_vectors", "vectors", "ids", "sizes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for qi, qv, cv, flat, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                own, q, v = np.frombuffer(qi, np.int64), np.frombuffer(qv, np.float64).reshape(-1, dim), np.frombuffer(cv, np.float64).reshape(-1, dim)
                ids = np.split(np.frombuffer(flat, np.int64), np.cumsum(np.frombuffer(sizes, np.int32))[:-1])
                for key, score in zip(own.tolist(), q @ v.T):
                    parts = held.setdefault(key, [])
                    parts.append(best(score, ids, key, k))
                    if len(parts) > 8:
                        parts[:] = [merge(parts, k)]
        rows = [(key, *merge(parts, k)) for key, parts in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

    found = met.mapInArrow(compare, "query_id long, ids array<long>, scores array<double>")

    def ranked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, scores = merge(list(zip(pdf["ids"], pdf["scores"])), k)
        return pd.DataFrame({"query_id": key[0], "rank": np.arange(1, len(ids) + 1), "vec_id": ids, "score": scores})

    return found.groupBy("query_id").applyInPandas(ranked, schema)
