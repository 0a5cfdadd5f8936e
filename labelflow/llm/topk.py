"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are quantised to floor(scale * x). A task reads its documents in ranges (Arrow batches), lays them out
in blocks of neighbours and keeps the largest and smallest value of each dimension per block. For a query, the
sum over dimensions of the larger of q*max and q*min bounds every score in the block. Blocks are visited in
descending order of that bound, scored through the block's own rows, until the next bound falls below the k-th
best score so far. The best k per task and query meet in one small shuffle.

Queries come in chunks of ``chunk`` rows, which is what a pass over the documents gets; the number of passes
grows with the queries, the size of what is sent does not: a hash of the id deals them out evenly. Of queries
that share an id, the one with the smallest vector is asked.

Vectors that are null or hold null, NaN or infinite components take no part. Shorter vectors count as padded
with zeros. Ties go to the smaller id. Repeated ids are candidates each; a query never finds its own id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.session import materialize

SCALE = 256
K = 5
BLOCK = 64
CHUNK = 4096
EXACT = float(1 << 53)


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): quantised vectors of the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad)
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))


def _matrix(lists, width: int) -> np.ndarray:
    lengths = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
    out = np.zeros((len(lists), max(width, int(lengths.max(initial=0)))), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : lengths[i]] = x
    return out


class Best:
    """The k best (score, id) of each query."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.real = np.zeros((n, k), dtype=bool)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, real: np.ndarray) -> None:
        k = self.score.shape[1]
        s = np.concatenate([self.score[rows], np.where(real, score, np.iinfo(np.int64).min)], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        r = np.concatenate([self.real[rows], real], axis=1)
        order = np.lexsort((i, -s.astype(np.float64) if abs(s[r]).max(initial=0) < EXACT else ~s, ~r), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.id[rows] = np.take_along_axis(i, order, 1)
        self.real[rows] = np.take_along_axis(r, order, 1)

    def floor(self) -> np.ndarray:
        """Score a block's bound must reach: that of the k-th, or anything while fewer are known."""
        return np.where(self.real[:, -1], self.score[:, -1].astype(np.float64), -np.inf)


def search(best: Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, docs: np.ndarray, block: int) -> int:
    """Adds a range of documents to ``best``; returns the number of (query, block) pairs scored."""
    width = max(queries.shape[1], docs.shape[1])
    q = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    d = np.pad(docs, ((0, 0), (0, width - docs.shape[1])))
    lead = np.argmax(np.abs(d), axis=1) if width else np.zeros(len(d), dtype=np.int64)
    at = np.arange(len(d))
    order = np.lexsort((at, d[at, lead] if width else at, lead))  # neighbours share their strongest dimension
    d, ids = d[order], ids[order]
    starts = np.arange(0, len(d), block)
    if width == 0:
        bound = np.zeros((len(q), len(starts)))
    else:
        high, low = (f.reduceat(d, starts, axis=0).astype(np.float64) for f in (np.maximum, np.minimum))
        qf = q.astype(np.float64)
        bound = np.maximum(qf, 0) @ high.T + np.minimum(qf, 0) @ low.T
        # a product is exact in doubles as long as no partial sum can pass 2**53
        exact = float(np.abs(qf).sum(axis=1).max(initial=0)) * float(np.abs(d).max(initial=0)) < EXACT
        bound = bound if exact else bound * (1 + 1e-12 * np.sign(bound)) + 1
        q, d = (qf, d.astype(np.float64)) if exact else (q, d)
    visits = np.argsort(-bound, axis=1, kind="stable")
    active, scored = np.arange(len(q)), 0
    for turn in range(len(starts)):
        chosen = visits[active, turn]
        keep = bound[active, chosen] >= best.floor()[active]
        active, chosen = active[keep], chosen[keep]
        if not len(active):
            break
        scored += len(active)
        by = np.argsort(chosen, kind="stable")
        cuts = np.flatnonzero(np.diff(chosen[by])) + 1
        for rows in np.split(active[by], cuts):
            lo = starts[visits[rows[0], turn]]
            there, found = ids[lo : lo + block], d[lo : lo + block]
            score = np.rint(q[rows] @ found.T).astype(np.int64) if width else np.zeros((len(rows), len(there)), np.int64)
            best.add(rows, score, there, there[None, :] != query_ids[rows][:, None])
    return scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query in (id, v) against all rows of vectors (id, v)."""
    one = queries.groupBy("id").agg(F.min("v").alias("v"))
    n = one.count()
    parts = max(1, -(-n // chunk))
    asked = materialize(one.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))), "queries")
    found = []
    for number in range(parts):
        rows = asked.where(F.col("part") == number).select("id", "v").collect()
        if not rows:
            continue
        ids = np.array([r["id"] for r in rows], dtype=np.int64)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, _matrix([r["v"] for r in rows], 0)))

        def work(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own, asked_for = sent.value
            best = Best(len(own), k)
            for frame in frames:
                if len(frame):
                    docs = _matrix(frame["v"].tolist(), asked_for.shape[1])
                    search(best, own, asked_for, frame["id"].to_numpy(), docs, block)
            at = np.nonzero(best.real)
            yield pd.DataFrame({"query_id": own[at[0]], "vec_id": best.id[at], "score": best.score[at]})

        part_best = vectors.mapInPandas(work, "query_id long, vec_id long, score long")
        found.append(materialize(part_best, "best") if parts > 1 else part_best)
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    merged = reduce(DataFrame.unionByName, found).withColumn("rank", place).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
