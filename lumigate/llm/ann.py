"""Approximate nearest neighbours by a hash-prefix forest.

Vectors fall at random into shards of a bounded size. In a shard each tree hashes every vector to a
string of 64 signs of random projections and keeps the strings as one sorted array. A query descends
each tree to the longest prefix it shares with any string there, whatever its length; then all trees
ascend together, one prefix length at a time, and each step admits the strings that share the
shorter prefix, until the candidates are enough. Candidates are ranked by exact cosine in double
precision, and the best of all shards are merged.

How many candidates are enough is fitted at index time on a bounded sample (SAMPLE vectors, half of
them as queries): the least share of a shard at which the forest's recall against brute force
reaches AIMED_RECALL there. Every vector is indexed; nothing is dropped.

Queries against all rows is the stated job: shards by query blocks, each cell a task of its own.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as queries or candidates; with fewer than k candidates all are returned;
ties go to the smaller vec_id; rows that repeat a vec_id count as candidates of their own, but a
query never finds its own vec_id, and of rows that repeat a query's vec_id the least vector asks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TREES, BITS = 48, 64
SHARD_ROWS, QUERY_ROWS = 16_384, 8_192
SAMPLE, AIMED_RECALL = 4_096, 0.96
SHARES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9, 1.0)
SEED = 11


def planes(dim: int, trees: int = TREES) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((trees, dim, BITS)).astype(np.float32)


def _strings(unit: np.ndarray, plane: np.ndarray) -> np.ndarray:
    signs = np.packbits(unit.astype(np.float32) @ plane > 0, axis=1)
    return signs.view(">u8").ravel().astype(np.uint64)


class Forest:
    """Sorted arrays of hash strings, one per tree, over the rows of `unit` (unit vectors)."""

    def __init__(self, unit: np.ndarray, trees: int = TREES):
        self.unit, self.planes = unit, planes(unit.shape[1], trees)
        self.order, self.sorted = [], []
        for plane in self.planes:
            strings = _strings(unit, plane)
            order = np.argsort(strings, kind="stable")
            self.order.append(order)
            self.sorted.append(strings[order])

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query the rows that the synchronous ascent has admitted when they are enough."""
        for at in range(0, len(queries), 512):
            yield from self._ascend(queries[at : at + 512], min(enough, len(self.unit)))

    def _ascend(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        own = [_strings(queries, plane) for plane in self.planes]
        bounds = []  # by prefix length: per tree and query, the run of strings that share it
        for length in range(BITS + 1):
            mask = np.uint64((2**length - 1) << (BITS - length)) if length else np.uint64(0)
            low = np.stack([np.searchsorted(s, q & mask, "left") for s, q in zip(self.sorted, own, strict=True)])
            high = np.stack([np.searchsorted(s, q | ~mask, "right") for s, q in zip(self.sorted, own, strict=True)])
            bounds.append((low, high))
            if (high - low).sum() == 0:
                break
        admitted = np.stack([(high - low).sum(axis=0) for low, high in bounds])
        n = len(self.unit)
        for i in range(len(queries)):
            # With repeats the runs of a length hold at least as many rows as without: start at the first length that can do.
            length = int(np.flatnonzero(admitted[:, i] >= enough)[-1])
            seen = np.zeros(len(self.unit), dtype=bool)
            runs = [(0, 0)] * len(self.order)
            while True:
                low, high = bounds[length][0][:, i].tolist(), bounds[length][1][:, i].tolist()
                for t, order in enumerate(self.order):
                    before, after = runs[t]
                    if before == after:
                        seen[order[low[t] : high[t]]] = True
                    else:
                        seen[order[low[t] : before]] = True
                        seen[order[after : high[t]]] = True
                    runs[t] = low[t], high[t]
                    # The last step goes round the trees and ends with the tree that makes it enough.
                    if t % 4 == 3 and np.count_nonzero(seen) >= enough:
                        break
                if length == 0 or np.count_nonzero(seen) >= enough:
                    break
                length -= 1
            yield np.flatnonzero(seen)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 8 * k:
        edge = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def fit_share(sample: np.ndarray, k: int) -> float:
    """The least share of candidates at which the forest over the sample reaches the recall aimed at."""
    if len(sample) < 200:
        return 1.0
    queries, base = sample[: min(256, len(sample) // 4)], sample[len(sample) // 4 :]
    true = np.argsort(-(queries @ base.T), axis=1, kind="stable")[:, :k]
    forest = Forest(base)
    for share in SHARES:
        found = [np.isin(t, c).mean() for t, c in zip(true, forest.candidates(queries, math.ceil(share * len(base))), strict=True)]
        if np.mean(found) >= AIMED_RECALL:
            return share
    return 1.0


def _valid(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = TREES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k nearest other rows found."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")).filter("vec_id is not null and v is not null")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    if lengths is None or not lengths.d:
        return spark.createDataFrame([], schema)
    dim, total = lengths.d, lengths["count"]
    rows = rows.filter(_valid(F.col("v"), dim))
    shards = max(1, math.ceil(total / SHARD_ROWS))
    sample = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()
    if not len(sample):
        return spark.createDataFrame([], schema)
    unit = np.stack(sample["v"].to_numpy())
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    share = fit_share(unit, k)
    counted = rows.filter("q").count()
    groups = max(1, math.ceil(counted / QUERY_ROWS), min(shards * 8, spark.sparkContext.defaultParallelism * 2) // shards if counted > 500 else 1)
    shard = F.pmod(F.xxhash64(F.lit(SEED + 1), "vec_id"), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64(F.lit(SEED + 2), "vec_id"), F.lit(groups)).cast("int")
    base = rows.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "vec_id", "v")
    asking = rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v"))  # a vec_id asks once
    asked = asking.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), group.alias("part"), "vec_id", "v")

    def cell(key: tuple, own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(own) and len(queries):
            ids = own["vec_id"].to_numpy()
            a, b = np.stack(own["v"].to_numpy()), np.stack(queries["v"].to_numpy())
            norms, b_norms = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            forest = Forest(a / norms[:, None], trees)
            enough = max(4 * k, math.ceil(share * len(own)))
            for i, some in enumerate(forest.candidates(b / b_norms[:, None], enough)):
                query = int(queries["vec_id"].iloc[i])
                some = some[ids[some] != query]
                if len(some) > 16 * k:
                    near = a[some] @ b[i] / norms[some]
                    some = some[near >= np.partition(near, len(some) - 4 * k)[len(some) - 4 * k]]
                scores = (a[some] * b[i]).sum(axis=1) / (norms[some] * b_norms[i])
                out += [(query, int(ids[some[j]]), float(scores[j])) for j in _best(scores, ids[some], k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = base.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(cell, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
