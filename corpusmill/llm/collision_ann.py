"""Nearest neighbours by collision counting over single-projection sorted arrays, with virtual rehashing.

Candidates are dealt to blocks of about `BLOCK_ROWS` vectors. A block keeps `PROJECTIONS` arrays, each with its vectors' places on
one random line, sorted. Around each query's place a window of width 2 R opens on every line; a vector collides on a line when
its place is inside, and one that collides on half of the lines is verified by its true distance. A vector at distance R
collides on a line with probability 0.68, so at radius R nearly all vectors within R are verified.

  first    each query is asked of one block, which widens its windows (virtual rehashing: wider buckets without a new
           index) until the k-th best verified distance is at most R, or all vectors have been verified: a bound.
  then     every other block opens that query's windows once, at the bound, since nothing beyond it can be among the k nearest.

Each block is indexed once a round and asked for all its queries together, `QUERY_ROWS` at a time. A query without k candidates in
its first block has no bound, and others widen for it. No candidate list is cut short; the blocks' k best are merged by query.
Distances are Euclidean in double precision on the original vectors.

Defined cases: vectors that are null, empty, zero, or hold nulls, NaN or infinities take no part, neither as queries nor
as candidates; vectors meet only vectors of as many dimensions; ties go to the smaller id; rows with the query's
own id are never its candidates; of a repeated query id the smallest vector is asked; with fewer than k candidates all
are returned; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared import discard, materialize

PROJECTIONS = 64
SHARE = 0.5  # of the lines that a candidate must collide on
GROWTH = 1.25
BLOCK_ROWS, QUERY_ROWS = 8192, 1024


class CollisionIndex:
    """Sorted single-projection arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.lines = np.random.default_rng(4).standard_normal((vectors.shape[1], projections))
        places = self.vectors @ self.lines
        self.order = np.argsort(places, axis=0, kind="stable")
        self.places = np.take_along_axis(places, self.order, 0)
        # where radii begin: half of a low quantile of distances from a few vectors
        some = self.vectors[:: max(1, len(ids) // 8)]
        d = np.sqrt(((some[:, None] - self.vectors[None, : 4 * 256]) ** 2).sum(2))
        d = d[d > 0]
        self.radius = float(np.quantile(d, 0.001)) / 2 if len(d) else 1.0

    def nearest(self, own_ids: np.ndarray, vectors: np.ndarray, k: int, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, distances) of the k nearest found, nearest first; bounds: radii beyond which nothing counts."""
        asked = vectors @ self.lines
        open_ = np.isfinite(bounds)
        m = self.order.shape[1]
        reach = np.where(open_, bounds, 0) + 1e-9 * (1 + np.abs(asked).max(1))  # places of equal vectors differ by rounding
        lo = np.stack([np.searchsorted(self.places[:, j], asked[:, j] - reach, "left") for j in range(m)], 1)
        hi = np.stack([np.searchsorted(self.places[:, j], asked[:, j] + reach, "right") for j in range(m)], 1)
        return [
            self._within(own_ids[i], vectors[i], lo[i], hi[i], k) if open_[i] else self._widening(own_ids[i], vectors[i], asked[i], k)
            for i in range(len(own_ids))
        ]

    def _best(self, rows: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        distance = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(1))
        first = np.lexsort((self.ids[rows], distance))[:k]
        return rows[first], distance[first]

    def _within(self, own_id: int, vector: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        inside = np.concatenate([self.order[x:y, j] for j, (x, y) in enumerate(zip(lo, hi, strict=True))])
        hits = np.bincount(inside, minlength=len(self.ids))
        rows, distance = self._best(np.flatnonzero((hits >= SHARE * len(lo)) & (self.ids != own_id)), vector, k)
        return self.ids[rows], distance

    def _widening(self, own_id: int, vector: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = self.order.shape
        away = np.abs(self.places - place)  # of the sorted places, line by line
        hits = np.zeros(n, np.int64)
        opened = np.zeros((n, m), bool)
        seen = self.ids == own_id  # never its own candidate
        radius, best, distance = self.radius, np.empty(0, np.int64), np.empty(0)
        while not ((len(best) == k and distance[-1] <= radius) or seen.all()):
            fresh_places = (away <= radius) & ~opened
            hits += np.bincount(self.order[fresh_places], minlength=n)  # a line holds a vector once
            opened |= fresh_places
            fresh = np.flatnonzero((hits >= SHARE * m) & ~seen)
            seen[fresh] = True
            best, distance = self._best(np.concatenate([best, fresh]), vector, k)
            radius *= GROWTH
        return self.ids[best], distance


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    x = F.col(vector)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return x.isNotNull() & F.coalesce(F.forall(x, finite), F.lit(False)) & F.exists(x, lambda v: v != 0)


def nearest_neighbours(
    queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest candidates of each query."""
    own = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & usable("v")
    )
    queries = own(queries).groupBy("id").agg(F.min("v").alias("v"))
    candidates = own(candidates)
    blocks = max(1, -(-candidates.count() // BLOCK_ROWS))
    rounds = max(1, -(-queries.count() // QUERY_ROWS))
    dims = F.size("v").alias("dims")
    number = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # any dealing does, as long as it is written and so the same for both passes; repeated ids are told apart by their vectors
    dealt = candidates.select(dims, "id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"))
    dealt = materialize(dealt, "candidates")
    asked = queries.select(dims, "id", "v", F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int").alias("round"))
    asked = asked.withColumn("home", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))

    def search(cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(cand) or not len(ask):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        index = CollisionIndex(cand["id"].to_numpy(np.int64), np.stack(list(cand["v"])))
        own_ids = ask["id"].to_numpy(np.int64)
        found = index.nearest(own_ids, np.stack(list(ask["v"])), k, ask["bound"].to_numpy(np.float64))
        return pd.DataFrame(
            {
                "query_id": np.repeat(own_ids, [len(f[0]) for f in found]),
                "id": np.concatenate([f[0] for f in found]),
                "score": np.concatenate([f[1] for f in found]),
            }
        )

    key = ["dims", "block", "round"]

    def met(asking: DataFrame) -> DataFrame:
        left = dealt.select("*", number(rounds).alias("round"))
        return left.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(search, "query_id long, id long, score double")

    first = materialize(met(asked.withColumn("block", F.col("home")).withColumn("bound", F.lit(float("inf")))), "first")
    bound = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("d"))
    bound = bound.select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("d")).alias("bound"))
    asked = asked.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    others = met(asked.select("*", number(blocks).alias("block")).filter("block != home"))
    tops = materialize(first.union(others), "tops")
    discard(dealt, first)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    ranked = tops.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
