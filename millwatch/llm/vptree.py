"""Nearest neighbours by a vantage-point tree per shard.

A node splits its points by the median distance to a vantage point and keeps the range of distances of each half. By the
triangle inequality nothing in a half is nearer than the query's distance to that range; a half is skipped if this bound,
times ``factor``, exceeds the k-th best distance so far. Factor one is exact, more skips more. All queries of a block go
down a shard's tree together, each to its nearer half first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from millwatch.llm.tables import pieces, stored

SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
#: Points of a leaf: as many as a matrix product does well with.
LEAF = 1024
FACTOR = 1.0
_SLACK = 1 + 1e-9


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row per query; components are added in their order, so that results do not depend on blocks."""
    out = np.zeros((len(queries), len(points)))
    for p, q in zip(points.T, queries.T):
        out += (q[:, None] - p[None, :]) ** 2
    return np.sqrt(out)


def _pair_distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The same for pairs, row by row."""
    out = np.zeros(len(points))
    for p, q in zip(points.T, queries.T):
        out += (q - p) ** 2
    return np.sqrt(out)


class Tree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int, leaf: int = LEAF, seed: int = 11):
        """Of equal points only the k + 1 smallest ids can be among a query's k nearest; the others are left out."""
        order = np.lexsort((ids, *points.T))
        points, ids = points[order], ids[order]
        new = np.concatenate(([True], (points[1:] != points[:-1]).any(axis=1)))
        place = np.arange(len(ids))
        keep = place - np.maximum.accumulate(np.where(new, place, 0)) <= k
        self.points, self.ids, self.leaf, self.rng = points[keep], ids[keep], leaf, np.random.default_rng(seed)
        with np.errstate(over="ignore"):
            self.norms = (self.points**2).sum(axis=1)
        self.root = self._build(np.arange(len(self.ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = self.points[self.rng.choice(rows)]
        away = distances(self.points[rows], vantage[None, :])[0]
        middle = np.median(away)
        inner = away <= middle
        if inner.all():  # many points at the same distance
            inner = away < middle
        if not inner.any() or inner.all():
            return rows
        halves = [(self._build(rows[side]), away[side].min(), away[side].max()) for side in (inner, ~inner)]
        return vantage, halves

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest of each query but its own id, ties to the smaller id; short of k, infinite."""
        best = np.full((len(queries), k), np.inf)
        ids = np.full((len(queries), k), np.iinfo(np.int64).max)

        def bound(far: np.ndarray, half) -> np.ndarray:
            return np.maximum(np.maximum(half[1] - far, far - half[2]), 0)

        with np.errstate(over="ignore"):
            norms = (queries**2).sum(axis=1)
        rounding = 4 * (queries.shape[1] + 8) * np.finfo(np.float64).eps

        def leaf(node: np.ndarray, who: np.ndarray) -> None:
            """Squared distances by one matrix product; what its rounding leaves open among the nearest is computed exactly."""
            points, asked = self.points[node], queries[who]
            sizes = norms[who][:, None] + self.norms[node][None, :]
            with np.errstate(over="ignore", invalid="ignore"):
                rough, slack = sizes - 2 * (asked @ points.T), rounding * sizes
                limit = best[who, -1] ** 2 * _SLACK
                if len(node) > k + 1:  # the query itself may be one of the points
                    limit = np.minimum(limit, np.partition(rough + slack, k, axis=1)[:, k])
                row, column = np.nonzero(~(rough - slack > limit[:, None]))  # also where numbers too large gave none
            other = self.ids[node][column] != own[who][row]
            row, column = row[other], column[other]
            if not len(row):
                return
            touched, at, count = np.unique(row, return_inverse=True, return_counts=True)
            place = k + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            near = np.full((len(touched), k + count.max()), np.inf)
            name = np.full(near.shape, np.iinfo(np.int64).max)
            near[:, :k], name[:, :k] = best[who[touched]], ids[who[touched]]
            near[at, place], name[at, place] = _pair_distances(points[column], asked[row]), self.ids[node][column]
            order = np.lexsort((name, near), axis=1)[:, :k]
            best[who[touched]], ids[who[touched]] = np.take_along_axis(near, order, 1), np.take_along_axis(name, order, 1)

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                leaf(node, who)
                return
            vantage, halves = node
            far = distances(vantage[None, :], queries[who])[:, 0]
            bounds = [bound(far, h) for h in halves]
            inner_first = bounds[0] < bounds[1]
            inner_first |= (bounds[0] == bounds[1]) & (far <= halves[0][2])
            for first, group in ((0, inner_first), (1, ~inner_first)):
                for side in (first, 1 - first):
                    live = group & (bounds[side] * factor <= best[who][:, -1] * _SLACK)
                    visit(halves[side][0], who[live])

        visit(self.root, np.arange(len(queries)))
        return best, ids


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the rows that take part: an id, and a vector that has only finite components and is
    not zero. Of rows that share an id, the vector that is smallest component by component stands for it."""
    v = vectors[vector].cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), F.when(fine, v).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all rows but their own.

    Rows lie in shards by the hash of their id; queries go to all shards in blocks. Vectors of different lengths never meet.
    Fewer than k candidates give fewer rows; no candidate, or an empty table, none.
    """
    rows = stored(usable(vectors, key, vector), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    shards, parts = pieces(counts["n"], SHARD_ROWS, 6), pieces(counts["q"], QUERY_ROWS)
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    points = rows.select(shard.alias("shard"), to_all(parts).alias("part"), F.size("v").alias("width"), "vec_id", "v")
    queries = rows.filter(F.col("vec_id") % every == 0).select(to_all(shards).alias("shard"), part.alias("part"), F.size("v").alias("width"), "vec_id", "v")

    def search(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        tree = Tree(np.stack(points["v"].to_numpy()), points["vec_id"].to_numpy(np.int64), k, LEAF)
        own = queries["vec_id"].to_numpy(np.int64)
        score, ids = tree.search(np.stack(queries["v"].to_numpy()), own, k, factor)
        found = np.isfinite(score)
        return pd.DataFrame({"query_id": np.repeat(own, k)[found.ravel()], "vec_id": ids[found], "score": score[found]})

    group = ["shard", "part", "width"]
    near = points.groupBy(*group).cogroup(queries.groupBy(*group)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH rows AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
