"""Approximate nearest neighbours by vantage-point trees, one tree per shard.

Vectors are dealt evenly into shards by a hash of their id (so copies of one vector spread too) and
queries into blocks; each (shard, block) is one task group of bounded size.  A group builds the
shard's tree (vantage point, median distance, two halves; leaves of LEAF vectors) and runs its
queries through it together.  The distance is the chord between unit vectors, a metric that falls
with growing cosine.  A child is skipped when its triangle-inequality bound, times FACTOR, is no
better than the query's k-th nearest so far.  FACTOR 1 is exact; larger factors skip more.  Queries
first walk to their own leaf, so that the bound is tight early; that path is never skipped, so the vectors
that set the bound are always found.

Scores are cosines of the original vectors in double precision, worked out pair by pair in a fixed
order, so equal vectors get equal scores and ties go to the smaller id.  Equal vectors of a shard
are one tree entry with its k + 1 smallest ids (no more can be among the k nearest of a query other
than one of them), so a large group of copies costs no more than one vector.

Every vector is indexed; there are no caps on what a query may reach.

Edge cases: null, empty, zero vectors, and those with null or non-finite parts, take no part; nor do
rows with a null id.  Vectors of different lengths aren't compared.  A repeated id keeps its
smallest vector (array order).  A query with no candidates has no rows.  Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickmetrics.llm.common import ship, written

K = 5
EVERY = 50
FACTOR = 4.0
LEAF = 256
SHARD = 20_000
QUERY_BLOCK = 2_000
MARGIN = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; every pair in the same order of sums."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


class Tree:
    """A vantage-point tree over unit vectors, as nested nodes of row numbers."""

    def __init__(self, units: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.units = units
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(units)), leaf)

    def _build(self, rows: np.ndarray, leaf: int):
        if len(rows) <= leaf:
            return (None, rows)
        at = int(self.rng.integers(len(rows)))
        point = rows[at]
        rest = np.delete(rows, at)
        far = self._chord(self.units[rest] @ self.units[point])
        half = len(rest) // 2
        order = np.argpartition(far, half)
        inner, outer = order[:half], order[half:]
        return (point, self._build(rest[inner], leaf), self._build(rest[outer], leaf),
                float(far[inner].max()), float(far[outer].min()))

    @staticmethod
    def _chord(cos):
        return np.sqrt(np.maximum(2 - 2 * cos, 0))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs that hold the ``k`` best cosines found of every query, and all that tie
        with them within MARGIN."""
        self.q, self.k, self.factor = queries, k, factor
        self.best = np.full((len(queries), k), -2.0)  # best cosines so far, ascending
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.done: set[tuple[int, int]] = set()
        everyone = np.arange(len(queries))
        self._descend(self.root, everyone)
        self.best[:] = np.sort(self.best, axis=1)
        bounds = self.best[:, 0].copy()
        # The second walk sees every vector once; the first one only gave starting bounds.
        self.best[:] = -2.0
        self.floor, self.found = bounds, []
        self._walk(self.root, everyone, np.zeros(len(queries)), np.ones(len(queries), bool))
        if not self.found:
            z = np.zeros(0, np.int64)
            return z, z
        q, r, s = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = s >= self.best[q, 0] - MARGIN
        return q[keep], r[keep]

    def _limit(self, active):
        return self._chord(np.maximum(self.best[active, 0], self.floor[active]))

    def _see(self, rows, active, keep_pairs=True):
        cos = self.q[active] @ self.units[rows].T
        merged = np.concatenate([self.best[active], cos], axis=1)
        k = self.k
        if merged.shape[1] > k:
            merged = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
        merged.sort(axis=1)
        self.best[active] = merged[:, -k:]
        if keep_pairs:
            a, b = np.nonzero(cos >= np.maximum(self.best[active, 0], self.floor[active])[:, None] - MARGIN)
            self.found.append((active[a], rows[b], cos[a, b]))

    def _descend(self, node, active):
        if not len(active):
            return
        if node[0] is None:
            if len(node[1]):
                self._see(node[1], active, keep_pairs=False)
            return
        point, near, far, inner, outer = node
        d = self._chord(self.q[active] @ self.units[point])
        inside = d <= (inner + outer) / 2
        self._descend(near, active[inside])
        self._descend(far, active[~inside])

    def _walk(self, node, active, bound, home):
        """``home``: whether the node is on the query's own path, which the first walk took."""
        alive = home | (bound * self.factor <= self._limit(active) + MARGIN)
        active, bound, home = active[alive], bound[alive], home[alive]
        if not len(active):
            return
        if node[0] is None:
            if len(node[1]):
                self._see(node[1], active)
            return
        point, near, far, inner, outer = node
        self._see(np.array([point]), active)
        d = self._chord(self.q[active] @ self.units[point])
        to_near, to_far = np.maximum(bound, d - inner), np.maximum(bound, outer - d)
        first = d <= (inner + outer) / 2
        self._walk(near, active[first], to_near[first], home[first])
        self._walk(far, active[~first], to_far[~first], home[~first])
        away = np.zeros(len(active), bool)
        self._walk(far, active[first], to_far[first], away[first])
        self._walk(near, active[~first], to_near[~first], away[~first])


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite part, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _group_task(k: int, factor: float, leaf: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                              "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values("id")
        vectors = np.stack(right["v"].to_numpy()).astype(np.float64)
        ids = right["id"].to_numpy()
        distinct, which = np.unique(vectors, axis=0, return_inverse=True)
        which = which.reshape(-1)
        # the k + 1 smallest ids of each distinct vector (ids are ascending)
        order = np.argsort(which, kind="stable")
        place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        order = order[place <= k]
        owners, owned = which[order], ids[order]
        first = np.searchsorted(owners, np.arange(len(distinct) + 1))
        queries = np.stack(left["v"].to_numpy()).astype(np.float64)
        q_ids = left["id"].to_numpy()
        # One vector more than k: a query may itself be one of them.
        q, r = Tree(unit(distinct), leaf).search(unit(queries), k + 1, factor)
        n = first[r + 1] - first[r]
        pair_q = np.repeat(q, n)
        pair_row = np.repeat(r, n)
        offset = np.arange(len(pair_q)) - np.repeat(np.cumsum(n) - n, n)
        pair_id = owned[first[pair_row] + offset]
        score = np.repeat(cosines(queries[q], distinct[r]), n) if len(q) else np.zeros(0)
        other = pair_id != q_ids[pair_q]
        out = pd.DataFrame({"query_id": q_ids[pair_q][other], "vec_id": pair_id[other], "score": score[other]})
        out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return out.groupby("query_id", sort=False).head(k)
    return run


def nearest(spark: SparkSession, queries: DataFrame, vectors: DataFrame, k: int = K, factor: float = FACTOR,
            shard: int = SHARD, query_block: int = QUERY_BLOCK, leaf: int = LEAF) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query (both inputs ``vec_id,
    embedding``); a row with the query's own id is never its neighbour."""
    ship(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        df = df.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
        df = df.filter(F.col("id").isNotNull() & usable(F.col("v")))
        return df.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

    right, left = written(spark, clean(vectors), "vectors"), written(spark, clean(queries), "queries")
    n_shards = max(1, -(-right.count() // shard))
    n_blocks = max(1, -(-left.count() // query_block))
    right = right.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    left = left.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    key = ("dim", "shard", "block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        _group_task(k, factor, leaf), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3(spark: SparkSession, embeddings: DataFrame, factor: float = FACTOR) -> DataFrame:
    return nearest(spark, embeddings.filter(F.col("vec_id") % EVERY == 0), embeddings, factor=factor)
