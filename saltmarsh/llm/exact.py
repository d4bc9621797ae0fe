"""Exact top-k by inner product: ball trees with branch and bound.

Components become integers, floor(1024 x). Rows are cut into shards of bounded
size; a task builds a ball tree over its shard and answers a block of queries.
For each query it opens nodes by their upper bound, q.c + |q| r for a ball with
center c and radius r, and stops when the highest bound left lies below the
query's kth score. One shard is searched first, and its kth scores are where all
other shards begin.

Vectors that are null or hold null or non-finite components take no part, nor
do null ids or vectors of another length than most. Rows with one id count once.
Queries with fewer candidates than k get all of them. Scores beyond the range of
a long are its ends.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from saltmarsh.llm.vectors import best, in_blocks, matrix, taking_part, without_surplus_copies
from saltmarsh.operators.rows import materialise

SCALE = 1024
SHARD_ROWS = 1 << 14
BLOCK_QUERIES = 1 << 11
LEAF_ROWS = 128
# Integers up to here are exact in a double.
EXACT = float(1 << 53)


class BallTree:
    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.first, self.last, self.left, self.right = [], [], [], []
        self.centers, self.radii = [], []
        self._build(points, 0, len(points))
        self.centers, self.radii = np.array(self.centers), np.array(self.radii)

    def _build(self, points: np.ndarray, first: int, last: int) -> int:
        node = len(self.first)
        own = points[self.order[first:last]]
        center = own.mean(0)
        distance = np.sqrt(((own - center) ** 2).sum(1))
        for values, value in zip(
            (self.first, self.last, self.left, self.right, self.centers, self.radii), (first, last, -1, -1, center, distance.max())
        ):
            values.append(value)
        if last - first > LEAF_ROWS and distance.max() > 0:
            # Along the line between two far points, half to either side.
            far = own[distance.argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            along = np.argsort(own @ (other - far), kind="stable")
            self.order[first:last] = self.order[first:last][along]
            middle = (first + last) // 2
            self.left[node] = self._build(points, first, middle)
            self.right[node] = self._build(points, middle, last)
        return node


def search_shard(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
    """(query id, id, score) of the k best of every query that reach its floor, by branch and bound."""
    tree = BallTree(points)
    sorted_ids, sorted_points = ids[tree.order], points[tree.order]
    lengths = np.sqrt((queries**2).sum(1))
    bounds = queries @ tree.centers.T + lengths[:, None] * tree.radii[None, :]
    # Bounds are rounded; the slack makes them safe.
    bounds += 1e-9 * (np.abs(bounds) + lengths[:, None] * (np.abs(tree.centers).max() + 1)) + 1e-6
    reach = np.abs(points).max() * np.abs(queries).max() * points.shape[1]
    exact = reach < EXACT
    if not exact:
        sorted_points = sorted_points.astype(object)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n, (own, query) in enumerate(zip(query_ids, queries)):
        top_scores = np.zeros(0, np.int64 if exact else object)
        top_ids = np.zeros(0, np.int64)
        kth = floors[n]
        heap = [(-bounds[n, 0], 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            if tree.left[node] >= 0:
                for child in (tree.left[node], tree.right[node]):
                    if bounds[n, child] >= kth:
                        heapq.heappush(heap, (-bounds[n, child], child))
                continue
            leaf = slice(tree.first[node], tree.last[node])
            if exact:
                scores = np.rint(sorted_points[leaf] @ query).astype(np.int64)
            else:
                scores = sorted_points[leaf] @ np.array([int(x) for x in query], object)
            keep = (scores >= kth) & (sorted_ids[leaf] != own)
            if not keep.any():
                continue
            top_scores = np.append(top_scores, scores[keep])
            top_ids = np.append(top_ids, sorted_ids[leaf][keep])
            order = sorted(range(len(top_ids)), key=lambda i: (-top_scores[i], top_ids[i]))[:k]
            top_scores, top_ids = top_scores[order], top_ids[order]
            if len(order) == k:
                kth = max(kth, float(top_scores[-1]))
        out.append((np.full(len(top_ids), own), top_ids, top_scores))
    limit = (1 << 63) - 1
    scores = [min(limit, max(-limit - 1, int(s))) for _, _, found in out for s in found]
    return np.concatenate([q for q, _, _ in out]), np.concatenate([i for _, i, _ in out]), np.array(scores, np.int64)


def top_k(rows: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for every row whose id is divisible by ``every``."""
    listed = materialise(taking_part(rows, key, vector, lambda x: F.floor(x * SCALE).cast("double")), "integers")
    data = materialise(without_surplus_copies(listed, k), "candidates")
    queries = listed.filter(F.col("id") % every == 0)
    count, asked = data.count(), queries.count()
    shards = max(1, -(-count // SHARD_ROWS))
    shard = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(shards)).cast("int")
    first, rest = data.filter(shard == 0), data.filter(shard != 0)
    schema = "query_id long, vec_id long, score long"

    def search(part: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        found = search_shard(
            part["id"].to_numpy(), matrix(part["v"]), questions["id"].to_numpy(), matrix(questions["v"]), questions["floor"].to_numpy(), k
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    def run(side: DataFrame, questions: DataFrame, size: int) -> DataFrame:
        cell = F.lit(0)
        return in_blocks(side.withColumn("cell", cell), questions.withColumn("cell", cell), {0: (size, asked)}, search, schema, SHARD_ROWS, BLOCK_QUERIES)

    open_floor = F.lit(float("-inf"))
    seen = materialise(best(run(first, queries.withColumn("floor", open_floor), SHARD_ROWS), k), "first-shard")
    if shards == 1:
        return seen
    floors = seen.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    informed = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", open_floor))
    more = run(rest, informed, count)
    return best(seen.drop("rank").unionByName(more), k)
