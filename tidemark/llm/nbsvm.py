"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread
from .shingles import CHUNK, Hasher, texts

#: Indicators: byte 1-, 2- and 3-grams share the buckets below RUNS; the last ones stand for runs
#: of one word (an n-gram of "the word before again", n = 1 to 8).
BUCKETS = 1 << 16
RUNS = BUCKETS - 8
#: Labelled rows that a model is fitted on, those with the least hash of doc_id; the bound of what the driver holds.
SAMPLE = 4000
EPOCHS, FOLDS, COST = 8, 3, 1.0

_A, _B = np.uint32(2654435761), np.uint32(2246822519)


def _buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that begin at each byte."""
    one = data.astype(np.uint32)
    two = one[:-1] * _A + one[1:] * _B if len(one) > 1 else one[:0]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * _A + one[2:] * _B if len(one) > 2 else one[:0]
    return one, *((((x ^ (x >> np.uint32(13))) * _A >> np.uint32(9)) % np.uint32(RUNS)) for x in (two, three))


def indicators(column: pa.Array | pa.ChunkedArray, hasher: Hasher) -> Iterator[np.ndarray]:
    """For each text the sorted distinct buckets of its n-grams; none for an empty one."""
    for _, data, offsets in texts(column):
        # a long text is read in blocks, each with the two bytes after it
        long = len(offsets) == 2 and len(data) > CHUNK
        word, at = hasher.words(data, offsets)
        same = np.zeros(len(word) + 1, bool)
        same[1:-1] = word[1:] == word[:-1]
        spans = [(0, None)] if long else list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        grams = None if long else _buckets(data)
        for i, (a, b) in enumerate(spans):
            seen = np.zeros(BUCKETS, bool)
            for block in range(0, len(data), CHUNK) if long else [None]:
                one, two, three = _buckets(data[block : block + CHUNK + 2]) if long else (x[a : max(a, b - k)] for k, x in enumerate(grams))
                seen[one] = seen[two] = seen[three] = True
            run = same[at[i] + 1 : at[i + 1]]
            n = 0
            while n < BUCKETS - RUNS and len(run) and run.any():
                seen[RUNS + n] = True
                run, n = run[1:] & run[:-1], n + 1
            yield np.flatnonzero(seen).astype(np.uint16)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, log-count ratio included
    scale: np.ndarray  # log-count ratio, for the length of a document's vector
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        r = self.scale[found]
        return float(self.weights[found].sum() / max(1e-9, np.sqrt((r * r).sum()))) + self.bias

    def score(self, found: np.ndarray) -> float:
        """Chance that the label is 1, between 0 and 1."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """log of (share of a bucket among class 1's indicators / its share among class 0's), each count raised by 1."""
    counts = np.ones((2, BUCKETS))
    for found, y in zip(rows, label, strict=True):
        counts[int(y), found] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], label: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared hinge loss with an L2 penalty, by coordinate steps in its dual.

    A document's vector holds r at its indicators, scaled to length 1, and a constant 1 for the bias.
    The rarer class costs more, so that both weigh alike in the sum.
    """
    y = np.where(label > 0, 1.0, -1.0)
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    upper = 1 / (2 * cost * 0.5 / np.maximum(share, 1e-9))[(y > 0).astype(int)]
    scale = np.array([1 / max(1e-9, np.sqrt((r[f] ** 2).sum())) for f in rows])
    w, b, alpha, order = np.zeros(BUCKETS), 0.0, np.zeros(len(rows)), np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f = rows[i]
            x = r[f] * scale[i]
            gradient = y[i] * (w[f] @ x + b) - 1 + alpha[i] * upper[i]
            after = max(0.0, alpha[i] - gradient / (2 + upper[i]))
            if after != alpha[i]:
                step = (after - alpha[i]) * y[i]
                w[f] += step * x
                b += step
                alpha[i] = after
    return w * r, b


def _sigmoid(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and shift of the logistic curve through (margin, label), by Newton steps, with smoothed targets."""
    n = np.array([(label == 0).sum(), (label == 1).sum()])
    target = np.where(label > 0, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x, p = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        hessian = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        p = p - np.clip(np.linalg.solve(hessian, x.T @ (q - target) + 1e-3 * (p - [1, 0])), -2, 2)
    return max(0.0, float(p[0])), float(p[1])


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """A model of (indicators, 0 or 1). Its chances are fitted on margins of rows that it was not fitted on.

    One class alone, or no rows: every text gets the share of label 1 (0.5 without rows).
    """
    label = np.asarray(label, np.int64)
    if len(set(label.tolist())) < 2:
        p = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(p / (1 - p))))
    fold, margin = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    for k in range(FOLDS):
        own = [rows[i] for i in np.flatnonzero(fold != k)]
        if len(set(label[fold != k].tolist())) < 2:
            continue
        r = log_count_ratios(own, label[fold != k])
        w, b = dual_coordinate_descent(own, label[fold != k], r)
        m = Model(w, r, b, 1, 0)
        margin[fold == k] = [m.margin(rows[i]) for i in np.flatnonzero(fold == k)]
    slope, shift = _sigmoid(margin, label)
    r = log_count_ratios(rows, label)
    w, b = dual_coordinate_descent(rows, label, r)
    return Model(w, r, b, slope, shift)


def held_out(doc_id: str = "doc_id"):
    """True for rows whose labels no model may learn from: crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, seed: int = 3) -> Model:
    """A model from at most `sample` labelled documents, none of them held out.

    Labels other than 0 and 1 and null ids are left out; of several labels of one id the largest counts.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    chosen = usable.withColumn("__key", spread(F.lit(seed), F.col("doc_id"))).orderBy("__key", "doc_id").limit(sample).select("doc_id", "y")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            if b.num_rows:
                rows = [x.tobytes() for x in indicators(b.column("text"), hasher)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "found"])

    # `chosen` has no more than `sample` rows, so each scan task can hold it
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found_rows = joined.select("doc_id", "text", "y").mapInArrow(found, "doc_id long, y int, found binary")
    # of rows that repeat an id one counts, so the driver gets no more than `sample`
    one_each = found_rows.groupBy("doc_id", "y").agg(F.min("found").alias("found"))
    got = sorted((r["doc_id"], r["y"], bytes(r["found"])) for r in one_each.collect())
    return fit([np.frombuffer(f, np.uint16) for _, _, f in got], np.array([y for _, y, _ in got], np.int64))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the model's score of every whole text; null texts score as empty ones."""
    weights, scale, bias, slope, shift = model.weights.astype(np.float32), model.scale.astype(np.float32), model.bias, model.slope, model.shift
    live = Model(weights, scale, bias, slope, shift)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            got = [live.score(f) for f in indicators(b.column(text_col), hasher)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, out])

    base = docs.drop(out)
    return base.mapInArrow(score, T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())]))
