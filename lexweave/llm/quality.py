"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

1. Every document gets a vote (bad, good or none) from each of the LABELLERS, which overlap; all documents are counted by vote
   pattern, so the model sees at most 3 ** len(LABELLERS) rows whatever the corpus.
2. Expectation-maximisation over the patterns estimates each labeller's votes given the class, and the posterior of each pattern.
3. The posteriors label SAMPLE documents (those of the smallest id hashes; a documented bound for fitting only), on
   which a logistic scorer over hashed character-class n-grams, words and repetition marks is fitted.
4. The scorer runs over every whole document where it is read.  Nothing is shuffled but the pattern counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import buffers, mix, pieces, word_hashes

#: Documents on which the scorer is fitted, at most.
SAMPLE = 4000
#: Hash space of each of the three kinds of features.
BITS = 16
KINDS = 3
BAD, GOOD, NONE = 0, 1, 2
#: (feature, at most this: good, at least this: bad); between, the labeller abstains.
LABELLERS = [
    ("symbol_bytes", 0.01, 0.04), ("upper_share", 0.25, 0.6), ("top_word_share", 0.15, 0.25), ("repeat_share", 0.03, 0.12),
    ("exclaims_a_word", 0.1, 0.4), ("bars_a_word", 0.02, 0.15), ("marks_a_word", 0.5, 1.0), ("common_share", 0.5, 0.75),
]
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|<>{}~^=@\\+", np.uint8))
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_CLASS = np.array([3 if 48 <= b < 58 else 2 if 65 <= b < 91 else 1 if chr(b).isalnum() or b >= 128 else 0 if b in b" \t\n\r\x0b\x0c" else 4 + (b * 7) % 59 for b in range(256)], np.uint64)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[off[1:]] - total[off[:-1]]


def word_repeats(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times that each word occurs in its text, whether it follows itself)."""
    order = np.lexsort((word, row))
    w, r = word[order], row[order]
    new = np.r_[True, (w[1:] != w[:-1]) | (r[1:] != r[:-1])] if len(w) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(w)))
    times = np.empty(len(w), np.int64)
    times[order] = np.repeat(size, size)
    follows = np.r_[False, (word[1:] == word[:-1]) & (row[1:] == row[:-1])] if len(w) else np.zeros(0, bool)
    return times, follows


def heuristics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(feature arrays, number of words) of texts without nulls."""
    data, off = buffers(texts)
    word, row = word_hashes(texts)
    n = np.bincount(row, minlength=len(texts)).astype(np.float64)
    times, follows = word_repeats(word, row)
    some = np.maximum(n, 1)
    upper, lower = sums((data >= 65) & (data <= 90), off), sums((data >= 97) & (data <= 122), off)
    top = np.zeros(len(texts))
    np.maximum.at(top, row, times)
    often = np.bincount(row, times >= np.maximum(3, 0.02 * n[row]), minlength=len(texts))
    found = {
        "symbol_bytes": sums(_SYMBOL[data], off) / np.maximum(np.diff(off), 1), "upper_share": upper / np.maximum(upper + lower, 1), "top_word_share": np.where(n >= 20, top / some, 0.2),
        "repeat_share": np.where(n >= 20, np.bincount(row, follows, minlength=len(texts)) / some, 0.05), "exclaims_a_word": sums(data == 33, off) / some, "bars_a_word": sums(data == 124, off) / some,
        "marks_a_word": sums(_MARK[data], off) / (n + 2), "common_share": np.where(n >= 50, often / some, 0.6),
    }
    return found, n


def patterns(texts: pa.Array) -> np.ndarray:
    """Each text's votes as digits to base 3; a text without words gets no vote at all."""
    found, n = heuristics(texts)
    code = np.zeros(len(texts), np.int64)
    for name, good, bad in LABELLERS:
        x = found[name]
        vote = np.where(x >= bad, BAD, np.where(x <= good, GOOD, NONE))
        code = code * 3 + np.where(n > 0, vote, NONE)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return codes[:, None] // 3 ** np.arange(k - 1, -1, -1)[None, :] % 3


class Labels:
    """What expectation-maximisation found: the share of each class, and each labeller's votes given the class."""

    def __init__(self, prior: np.ndarray, tables: np.ndarray) -> None:
        #: (2,) logarithms of the classes' shares; (2, labellers, 3) logarithms of the votes' shares, 0 for none.
        self.prior, self.tables = prior, tables

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """P(good) of any vote patterns, seen before or not."""
        votes = votes_of(np.asarray(codes))
        like = self.prior[None, :] + self.tables[:, np.arange(votes.shape[1]), votes].sum(2).T
        return 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Labels:
    """Accuracies of the labellers from the counts of vote patterns, by expectation-maximisation from "no labeller votes bad".

    Without any pattern both classes are as likely, and no vote tells them apart.
    """
    votes = votes_of(codes)
    p = np.where((votes == BAD).any(1), 0.1, 0.9)
    for _ in range(rounds):
        prior, tables = np.zeros(2), np.zeros((2, len(LABELLERS), 3))
        for c, q in enumerate((1 - p, p)):
            weight = q * counts
            prior[c] = np.log(weight.sum() + 1)
            for j in range(len(LABELLERS)):
                table = np.bincount(votes[:, j], weight, 3) + 0.1
                tables[c, j] = np.log(table / table.sum())
        tables[:, :, NONE] = 0
        found = Labels(prior - np.log(np.exp(prior).sum()), tables)
        new = found(codes)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return found


def hashed(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) pairs of each kind: class 4-grams of bytes, words, and repetition marks of words."""
    data, off = buffers(texts)
    mask = np.uint64((1 << BITS) - 1)
    kinds = []
    if len(data) >= 4:
        c = _CLASS[data]
        gram = c[:-3] | c[1:-2] << np.uint64(6) | c[2:-1] << np.uint64(12) | c[3:] << np.uint64(18)
        row = np.repeat(np.arange(len(texts)), np.diff(off))
        on = row[:-3] == row[3:]
        gram *= np.uint64(0x9E3779B97F4A7C15)
        kinds.append((row[:-3][on], (gram[on] >> np.uint64(64 - BITS)).astype(np.int64)))
    else:
        kinds.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    word, row = word_hashes(texts)
    kinds.append((row, (word & mask).astype(np.int64) + (1 << BITS)))
    times, follows = word_repeats(word, row)
    n = np.bincount(row, minlength=len(texts))
    share = np.minimum(15, (np.log2(np.maximum(times / np.maximum(n[row], 20), 1e-4)) + 14).astype(np.int64))
    mark = mix((share * 2 + follows).astype(np.uint64) + np.uint64(7)) & mask
    kinds.append((row, mark.astype(np.int64) + (2 << BITS)))
    return kinds


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """P(good); 0 for a text without words."""
    total, words = np.full(len(texts), bias), np.zeros(len(texts))
    for kind, (row, feature) in enumerate(hashed(texts)):
        n = np.bincount(row, minlength=len(texts))
        total += np.bincount(row, weights[feature], minlength=len(texts)) / np.maximum(n, 1)
        words = n if kind == 1 else words
    return np.where(words > 0, 1 / (1 + np.exp(-np.clip(total, -500, 500))), 0.0)


def fit_scorer(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 12, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic regression by adaptive gradient steps; examples are (features, values, P(good))."""
    weights, seen, bias = np.zeros(KINDS << BITS), np.full(KINDS << BITS, 1e-6), 0.0
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            feature, value, label = examples[i]
            g = 1 / (1 + np.exp(-np.clip(weights[feature] @ value + bias, -500, 500))) - label
            step = g * value
            seen[feature] += step * step
            weights[feature] -= rate * 0.1 * step / np.sqrt(seen[feature])
            bias -= 0.02 * g
    return weights, bias


class Model:
    """A fitted scorer, which holds for tables other than the one it was fitted on; `weak` gives P(good) of vote patterns."""

    def __init__(self, weights: np.ndarray, bias: float, weak: Labels) -> None:
        self.weights, self.bias, self.weak = weights, bias, weak


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Vote patterns of all documents, and the scorer on at most `sample` of them.

    Null, empty and wordless texts get no votes and teach nothing; a text of any length is read whole; repeated rows count each time.  An
    empty table gives a scorer that takes any text with words for good and bad alike (0.5).  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, part in pieces(batch.column(0)):
                total += np.bincount(patterns(part), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    counted = rows.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    codes, counts = counted["code"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    weak = estimate(codes, counts)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in pieces(batch.column(0)):
                code, lists = patterns(part), [([], []) for _ in range(len(part))]
                for row, feature in hashed(part):
                    pair, times = np.unique(row * (KINDS << BITS) + feature, return_counts=True)
                    row, feature = np.divmod(pair, KINDS << BITS)
                    n = np.bincount(row, times, minlength=len(part))
                    cut = np.searchsorted(row, np.arange(len(part) + 1))
                    for i in range(len(part)):
                        at = slice(cut[i], cut[i + 1])
                        lists[i][0].append(feature[at])
                        lists[i][1].append(times[at] / max(n[i], 1))
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array([np.concatenate(a).astype(np.int32).tobytes() for a, _ in lists]), pa.array([np.concatenate(b).astype(np.float32).tobytes() for _, b in lists])], ["code", "feature", "value"])

    key = F.xxhash64("id", F.sha1(F.coalesce("text", F.lit(""))))
    keys = rows.select(key.alias("k")).orderBy("k").limit(sample)
    last = keys.agg(F.max("k")).first()[0]
    chosen = rows.filter(key <= last if last is not None else F.lit(False)).select("text").mapInArrow(vectors, "code long, feature binary, value binary").limit(2 * sample)
    model = Model(np.zeros(KINDS << BITS), 0.0, weak)
    examples = [(np.frombuffer(r["feature"], np.int32), np.frombuffer(r["value"], np.float32), model.weak(np.array([r["code"]]))[0]) for r in sorted(chosen.collect())]
    model.weights, model.bias = fit_scorer([e for e in examples if len(e[0])])
    return model


def classified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, weak, score, quality): one row for each row of `docs`.

    `quality` is 1 where the score is at least 0.5.  Null, empty and wordless texts score 0.  Repeated rows are scored alike; ids may be
    null or repeat.  An empty table gives no rows; a text of any length is scored whole; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # KINDS << BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in pieces(batch.column(1)):
                score = scores(part, held.value.weights, held.value.bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(held.value.weak(patterns(part))), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "weak", "score", "quality"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, weak double, score double, quality int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that the scorer rejects; columns unchanged, nothing shuffled.

    Rows with null, empty or wordless texts go; an empty table stays empty; repeated rows stay or go together.
    """
    held, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.concatenate([scores(part, held.value.weights, held.value.bias) >= 0.5 for _, part in pieces(batch.column(at_text))] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
