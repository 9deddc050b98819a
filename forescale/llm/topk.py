"""Exact top-k inner products: a ball tree per shard, branch and bound, and the kth score shared between shards.

Rows are dealt to shards of about ``SHARD_ROWS`` vectors and queries to blocks of about ``BLOCK_ROWS``; one task holds
one shard and one block. First each query searches the shard it was dealt to; its kth score there is the bound that it
takes to all other shards. Inside a shard, nodes are visited by their upper bound q.c + |q| r, larger first, and left out
when it falls below the current kth score.

Defined results: vectors that are null or hold null or non-finite components take no part; only vectors of the same
length meet (empty ones score 0); candidates are rows with another vec_id, ties go to the smaller vec_id; a vec_id that
stands in several rows is a query once for each different vector, and each row is a candidate; null vec_ids are no
queries and no candidates. Scores beyond a long stop at its limits. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from forescale.llm.common import staged

SHARD_ROWS = 16384
BLOCK_ROWS = 4096
LEAF_ROWS = 256
LEAST = -(1 << 63)


class BallTree:
    """Over distinct vectors; each keeps its smallest ``k + 1`` ids, more can't enter a result."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        _, of = np.unique(vectors[order], axis=0, return_inverse=True)
        of = of.reshape(-1)
        by = np.argsort(of, kind="stable")
        place = np.arange(len(by)) - np.searchsorted(of[by], of[by])
        order = order[by[place <= k]]
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes: list[tuple] = []  # centre, radius, start, stop, left, right
        self.rows = np.arange(len(order))
        if len(order):
            self.build(0, len(order))
        self.ids, self.vectors = self.ids[self.rows], self.vectors[self.rows]

    def build(self, start: int, stop: int) -> int:
        points = self.vectors[self.rows[start:stop]]
        centre = points.mean(0)
        away = points - centre
        radius = math.sqrt(float((away * away).sum(1).max())) if points.shape[1] else 0.0
        number = len(self.nodes)
        self.nodes.append(())
        left = right = -1
        if stop - start > LEAF_ROWS:
            far = points[(away * away).sum(1).argmax()] if points.shape[1] else centre
            other = points[((points - far) ** 2).sum(1).argmax()]
            middle = (stop - start) // 2
            along = np.argpartition(points @ (other - far), middle)
            self.rows[start:stop] = self.rows[start:stop][along]
            left, right = self.build(start, start + middle), self.build(start + middle, stop)
        self.nodes[number] = (centre, radius, start, stop, left, right)
        return number


class Search:
    def __init__(self, tree: BallTree, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
        self.tree, self.own, self.queries, self.floors, self.k = tree, ids, queries, floors, k
        self.norms = np.sqrt((queries * queries).sum(1))
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        if tree.nodes and len(ids):
            self.visit(0, np.arange(len(ids)))

    def bound(self, node: int, of: np.ndarray) -> np.ndarray:
        centre, radius = self.tree.nodes[node][:2]
        reach = np.abs(self.queries[of]) @ np.abs(centre) + self.norms[of] * radius
        return self.queries[of] @ centre + self.norms[of] * radius + 1e-9 * reach + 1e-6  # above any rounding

    def open(self, node: int, of: np.ndarray) -> np.ndarray:
        return of[self.bound(node, of) >= np.maximum(self.scores[of, -1], self.floors[of])]

    def visit(self, node: int, of: np.ndarray) -> None:
        _, _, start, stop, left, right = self.tree.nodes[node]
        if left < 0:
            self.leaf(of, start, stop)
            return
        first = self.bound(left, of) >= self.bound(right, of)
        for part, near, far in ((of[first], left, right), (of[~first], right, left)):
            for child in (near, far):
                part_open = self.open(child, part)
                if len(part_open):
                    self.visit(child, part_open)

    def leaf(self, of: np.ndarray, start: int, stop: int) -> None:
        ids = self.tree.ids[start:stop]
        scores = self.queries[of] @ self.tree.vectors[start:stop].T
        scores[self.own[of][:, None] == ids[None, :]] = -np.inf
        better = (scores.max(1) >= np.maximum(self.scores[of, -1], self.floors[of])).nonzero()[0]
        of, scores = of[better], scores[better]
        all_scores = np.hstack([self.scores[of], scores])
        all_ids = np.hstack([self.found[of], np.broadcast_to(ids, scores.shape)])
        best = np.lexsort((all_ids, -all_scores), axis=-1)[:, : self.k]
        self.scores[of], self.found[of] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)


def fits(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether all inner products are exact in doubles."""
    return float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1]) < 2**53


def search_whole_numbers(ids: np.ndarray, queries: np.ndarray, of: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's place, vec_id, score) for components too large for doubles: every pair in whole numbers, ``k`` kept."""
    whole = [[int(x) for x in v] for v in vectors]
    found = []
    for place, (own, query) in enumerate(zip(ids.tolist(), queries)):
        q = [int(x) for x in query]
        scores = ((min(max(sum(map(mul, q, v)), LEAST), -LEAST - 1), i) for i, v in zip(of.tolist(), whole) if i != own)
        found += [(place, i, s) for s, i in heapq.nsmallest(k, scores, key=lambda x: (-x[0], x[1]))]
    return found


def scaled(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim and whole-number components, of vectors that take part."""
    vector = F.col("embedding")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    large = float(1 << 52)  # doubles beyond are whole numbers

    def floored(x):
        value = x.cast("double") * scale
        return F.when(F.abs(value) < large, F.floor(value).cast("double")).otherwise(value)

    whole = F.transform(vector, floored)
    return rows.where(F.col("vec_id").isNotNull() & vector.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(vector).alias("dim"), whole.alias("v"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query, query_id, vec_id, score: the best ``k`` of each (dim, shard, block) group, none below the query's floor."""
    schema = "query string, query_id long, vec_id long, score long"

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": pd.Series([], dtype=str), "query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="int64")})
        asked, queries, ids, vectors = left.vec_id.to_numpy(), matrix(left.v), right.vec_id.to_numpy(), matrix(right.v)
        if fits(queries, vectors):
            found = Search(BallTree(ids, vectors, k), asked, queries, left.floor.to_numpy(), k)
            q, place = (found.scores > -np.inf).nonzero()
            best, scores = found.found[q, place], found.scores[q, place].astype(np.int64)
        else:
            rows = np.array(search_whole_numbers(asked, queries, ids, vectors, k), np.int64).reshape(-1, 3)
            q, best, scores = rows[:, 0], rows[:, 1], rows[:, 2]
        return pd.DataFrame({"query": left["query"].to_numpy()[q], "query_id": asked[q], "vec_id": best, "score": scores})

    keys = ("dim", "shard", "block")
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInPandas(run, schema)


def top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id is divisible by ``every``."""
    base = staged(scaled(rows, scale), "vectors")
    total = base.count()
    shards = max(1, math.ceil(total / SHARD_ROWS))
    is_query = F.col("vec_id") % every == 0
    queries = base.where(is_query).distinct().toDF("vec_id", "dim", "v")
    blocks = max(1, math.ceil(base.where(is_query).count() / BLOCK_ROWS))
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    vectors = base.select(*[F.col(c).alias(c) for c in base.columns]).withColumn("shard", dealt(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asked = queries.withColumns({"home": dealt(shards, 1), "block": dealt(blocks, 2), "query": F.concat_ws(" ", F.col("vec_id"), F.xxhash64("v"))})
    first = search(asked.withColumns({"shard": F.col("home"), "floor": F.lit(float("-inf"))}), vectors, k)
    if shards > 1:
        first = staged(first, "home-scores")
        floors = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
        rest = asked.join(floors, "query", "left").fillna({"floor": float("-inf")})
        rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).where("shard <> home")
        first = first.unionByName(search(rest, vectors, k))
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
