"""Exact top-k search by integer inner product over a vector-approximation file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tables of smaller integer components go as int; any other goes as double, which holds every floor of a large double.
LARGEST = 2**26
#: Up to this size, products of components and sums of them are doubles.
BOUNDED = 2.0**480
#: Vectors in a block, and queries in a block: a task holds one block of either at a time.
BLOCK, QUERIES = 4096, 512
#: Queries that meet a block in one task.
PART = 8 * QUERIES

#: A score that no long holds is null; over is its sign, big its place among such scores as BIG bytes.
_RESULT = "query_id long, vec_id long, score long, over int, big binary"
BIG = 512


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component, as doubles.

    Null vectors and those with null or non-finite components (after scaling, which no finite
    float leaves) are left out. An empty vector scores 0 with every other empty one.
    """
    x = F.transform(F.col(vector_col), lambda c: F.lit(float(scale)) * c.cast("double"))
    # floor gives a long; a double of 2**53 or more has no fraction
    ints = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))


class _Block:
    """Vectors of one block and their approximations: a cell of 8 bits for each component.

    A component lies in [low + cell * width, low + (cell + 1) * width], so an inner product is
    bounded by one product with the cells and two sums over the query.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.exact = ids, vectors
        self.low = vectors.min(axis=0)
        self.width = (vectors.max(axis=0) - self.low + 1) / 256.0
        self.top = np.abs(vectors).max(axis=0)
        self.cells = np.clip((vectors - self.low) / self.width, 0, 255).astype(np.uint8).astype(np.float32)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, queries by vectors."""
        largest = max(self.top.max(initial=0), np.abs(q).max(initial=0))
        if largest > BOUNDED:
            none = np.full((len(q), len(self.ids)), np.inf)
            return -none, none
        qw = q * self.width
        single = qw.astype(np.float32) if largest < LARGEST else qw
        near = (single @ self.cells.T).astype(np.float64) + (q @ self.low)[:, None]
        # single precision in the product above: 2**-20 of the largest possible sum covers it
        slack = np.abs(qw).sum(axis=1, keepdims=True) * (256 * 2.0**-20 * max(1, q.shape[1] / 16)) + 1
        # and double precision of large components in all of it
        slack += (np.abs(q) @ self.top)[:, None] * (2.0**-49 * (q.shape[1] + 1))
        return near + np.minimum(qw, 0).sum(axis=1, keepdims=True) - slack, near + np.maximum(qw, 0).sum(axis=1, keepdims=True) + slack

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
        low, high = self.bounds(q)
        own = query_ids[:, None] == self.ids[None, :]
        low[own], high[own] = -np.inf, -np.inf
        m = min(k, len(self.ids))
        # at least m vectors reach this bound, so none below it can be among the m best
        least = np.partition(low, len(self.ids) - m, axis=1)[:, len(self.ids) - m]
        out = []
        # Python's integers where a long might not hold a sum
        self.long = float(self.top.max(initial=0)) * float(np.abs(q).max(initial=0)) * q.shape[1] < 2.0**62
        for i in range(len(q)):
            found = np.flatnonzero((high[i] >= least[i]) & ~own[i])
            found = found[np.argsort(-high[i, found], kind="stable")]
            ids, scores = self._read(found, high[i], q[i], m)
            out.append(_found(query_ids[i], ids, scores))
        return pd.concat(out)

    def _read(self, found: np.ndarray, high: np.ndarray, q: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Reads exact vectors in the order of their bounds, until no bound reaches the m-th score."""
        kind = np.int64 if self.long else object
        ids, scores = np.empty(0, np.int64), np.empty(0, kind)
        q = q.astype(np.int64) if self.long else _integers(q)
        at, step = 0, max(4 * m, 64)
        while at < len(found) and (len(scores) < m or high[found[at]] >= scores[-1]):
            part = found[at : at + step]
            exact = self.exact[part].astype(np.int64) @ q if self.long else np.array([sum(a * b for a, b in zip(v, q, strict=True)) for v in _integers(self.exact[part])], object)
            ids, scores = np.concatenate([ids, self.ids[part]]), np.concatenate([scores, exact])
            best = np.lexsort((ids, -scores))[:m] if self.long else sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:m]
            ids, scores = ids[best], scores[best]
            at, step = at + step, step * 2
        return ids, scores


def _integers(x: np.ndarray) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


def _found(query_id: int, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
    if scores.dtype != object:
        return pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": pd.array(scores, "Int64"), "over": 0, "big": None})
    over = [(s >= 2**63) - (s < -(2**63)) for s in scores]
    held = pd.array([None if o else s for s, o in zip(scores, over, strict=True)], "Int64")
    # shifted by half of what BIG bytes hold, so that bytes compare as the scores do
    big = [int(s + (1 << (8 * BIG - 1))).to_bytes(BIG, "big") if o else None for s, o in zip(scores, over, strict=True)]
    return pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": held, "over": over, "big": pd.Series(big, dtype=object)})


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """For each row that `queries` selects, its k best other rows: query_id, rank, vec_id, score.

    Score: inner product of floor(scale * x), exact at any size; one that a long cannot hold has
    its right rank and is null itself. Ties go to the smaller id; rows with the query's
    own id never count. Fewer than k others: all of them. Vectors of another length than the
    query's cannot be scored and are no candidates. Of query rows that repeat an id the one with
    the least vector asks; candidate rows that repeat an id count each. An empty table gives no rows.

    Vectors are dealt into blocks, queries into parts, both by a hash of the id. Each block meets
    each part in a task that holds these two alone, and gives k rows for a query at most; the
    best of those are taken by a second, partly pre-sorted step.
    """
    ints = integer_vectors(vectors, id_col, vector_col, scale)
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    kind = "array<int>" if (ints.agg(largest).first()[0] or 0) < LARGEST else "array<double>"
    asked = integer_vectors(vectors.where(queries), id_col, vector_col, scale).groupBy("id").agg(F.min("v").cast(kind).alias("v"))
    ints = ints.withColumn("v", F.col("v").cast(kind))
    blocks, parts = max(1, -(-vectors.count() // BLOCK)), max(1, -(-asked.count() // PART))
    dealt = ints.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    sent = asked.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [_found(0, np.empty(0, np.int64), np.empty(0, np.int64))]
        held = {dim: _Block(own["id"].to_numpy(np.int64), _stack(own["v"])) for dim, own in left.groupby(left["v"].map(len))}
        for dim, own in right.groupby(right["v"].map(len)):
            for at in range(0, len(own) if dim in held else 0, QUERIES):
                part = own.iloc[at : at + QUERIES]
                found.append(held[dim].search(part["id"].to_numpy(np.int64), _stack(part["v"]), k))
        return pd.concat(found)

    found = dealt.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInPandas(meet, _RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), F.desc("big"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
