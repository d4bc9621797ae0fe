"""Approximate nearest neighbours by cosine: a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE_ROWS``); every row is then put
into a leaf by walking down to the nearest child. A query opens nodes through a
priority queue, nearest center first, and visits the leaves that come out. How
many it visits is calibrated: for a bounded set of queries the true neighbours
are found by brute force over all rows, and the number of leaves is widened
until their recall reaches the goal. Leaves of any size are searched in blocks.

Vectors that are null, zero or hold null or non-finite components take no part,
nor do null ids or vectors of another length than most. Rows with one id count
once. Queries with fewer candidates than k get all they find.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from saltmarsh.llm.vectors import best, in_blocks, matrix, taking_part, without_surplus_copies
from saltmarsh.operators.rows import materialise

SAMPLE_ROWS = 16_000
CALIBRATION_QUERIES = 200
RECALL = 0.97
BRANCHES = 8
LEAF_SAMPLE = 48
BLOCK_ROWS = 1 << 12
BLOCK_QUERIES = 1 << 12
# Estimates may differ from exact scores by so much; all within it are measured exactly.
SLACK = 1e-9


@dataclass
class Tree:
    centers: np.ndarray  # one row per node, the root first
    children: list[list[int]]  # none for a leaf

    def leaves_by_nearness(self, queries: np.ndarray, visits: int) -> list[list[int]]:
        """The first leaves of every query, best bin first."""
        near = queries @ self.centers.T
        out = []
        for row in near:
            heap, found = [(-2.0, 0)], []
            while heap and len(found) < visits:
                _, node = heapq.heappop(heap)
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(heap, (-row[child], child))
                else:
                    found.append(node)
            out.append(found)
        return out

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf that every point belongs to."""
        at = np.zeros(len(points), np.int64)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, members = waiting.pop()
            at[members] = node
            if self.children[node] and len(members):
                nearest = np.argmax(points[members] @ self.centers[self.children[node]].T, 1)
                waiting += [(child, members[nearest == n]) for n, child in enumerate(self.children[node])]
        return at


def fit_tree(points: np.ndarray, seed: int = 5) -> Tree:
    """Hierarchical k-means of unit vectors, down to leaves of some ``LEAF_SAMPLE`` points."""
    random = np.random.default_rng(seed)
    centers, children, waiting = [unit(points.mean(0, keepdims=True))[0]], [[]], [(0, points)]
    while waiting:
        node, own = waiting.pop()
        if len(own) <= LEAF_SAMPLE:
            continue
        k = min(BRANCHES, -(-len(own) // LEAF_SAMPLE))
        middle = own[random.choice(len(own), k, replace=False)]
        for _ in range(12):
            nearest = np.argmax(own @ middle.T, 1)
            sums = np.zeros_like(middle)
            np.add.at(sums, nearest, own)
            filled = np.bincount(nearest, minlength=k) > 0
            middle[filled] = unit(sums[filled])
        nearest = np.argmax(own @ middle.T, 1)
        parts = [(c, own[nearest == c]) for c in range(k) if (nearest == c).any()]
        if len(parts) < 2:  # all points alike
            continue
        for c, part in parts:
            children[node].append(len(centers))
            waiting.append((len(centers), part))
            centers.append(middle[c])
            children.append([])
    return Tree(np.array(centers), children)


def unit(points: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaling first keeps very long and very short ones finite."""
    points = points / np.maximum(np.abs(points).max(1, keepdims=True), 1e-300)
    return points / np.maximum(np.sqrt((points**2).sum(1, keepdims=True)), 1e-300)


def lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fit(data: DataFrame, count: int) -> Tree:
    part = min(1.0, SAMPLE_ROWS / max(1, count))
    drawn = data.filter(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < part * (1 << 30)).select("id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("id").combine_chunks()
        tree = fit_tree(unit(lists(table.column("v").combine_chunks())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(tree.children))), pa.array(tree.centers.tolist(), pa.list_(pa.float64())), pa.array(tree.children, pa.list_(pa.int32()))],
            ["node", "center", "children"],
        )

    # The sample is bounded, so one task holds it; so is the tree.
    nodes = sorted(drawn.repartition(1).mapInArrow(run, "node long, center array<double>, children array<int>").collect())
    return Tree(np.array([n["center"] for n in nodes]), [list(n["children"]) for n in nodes])


def cosines(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Cosine of a vector with every row, each row by itself, so that equal rows score alike."""
    return (points * query).sum(1) / (np.sqrt((query * query).sum()) * np.sqrt((points * points).sum(1)))


def search_block(part: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of the block for every query, by exact score and then id."""
    ids, points = part["id"].to_numpy(), matrix(part["v"])
    questions, vectors = asked["id"].to_numpy(), matrix(asked["v"])
    estimates = unit(vectors) @ unit(points).T
    estimates[questions[:, None] == ids[None, :]] = -np.inf
    out_q, out_i, out_s = [], [], []
    take = min(k, len(ids))
    least = np.partition(estimates, len(ids) - take, axis=1)[:, len(ids) - take]
    for n, question in enumerate(questions):
        near = np.flatnonzero((estimates[n] >= least[n] - SLACK) & (ids != question))
        if len(near):
            scores = cosines(vectors[n], points[near])
            order = np.lexsort((ids[near], -scores))[:k]
            out_q.append(np.full(len(order), question))
            out_i.append(ids[near][order])
            out_s.append(scores[order])
    if not out_q:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_s)})


FOUND = "query_id long, vec_id long, score double"


def _true_leaves(data: DataFrame, questions: list, k: int) -> list[tuple[int, int]]:
    """(query, leaf) of the k nearest rows of each of a few queries, by brute force over all rows."""
    asked = pd.DataFrame({"id": [q["id"] for q in questions], "v": [q["v"] for q in questions]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = pd.DataFrame({"id": batch.column(0).to_numpy(), "v": list(lists(batch.column(1)))})
                leaf = dict(zip(part["id"], batch.column(2).to_pylist()))
                found = search_block(part, asked, k)
                found["leaf"] = [leaf[i] for i in found["vec_id"]]
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    near = data.select("id", "v", "cell").mapInArrow(run, FOUND + ", leaf long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return [(r["query_id"], r["leaf"]) for r in near.withColumn("rank", rank).filter(F.col("rank") <= k).collect()]


def _calibrated(tree: Tree, data: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """The least number of leaves whose rows hold the goal's share of true neighbours."""
    leaves = sum(not c for c in tree.children)
    questions = queries.orderBy(F.xxhash64(F.lit(23), "id"), "id").limit(CALIBRATION_QUERIES).select("id", "v").collect()
    if not questions:
        return leaves
    order = tree.leaves_by_nearness(unit(np.array([q["v"] for q in questions])), leaves)
    place = {q["id"]: {leaf: n for n, leaf in enumerate(found)} for q, found in zip(questions, order)}
    ranks = sorted(place[q][leaf] for q, leaf in _true_leaves(data, questions, k))
    if not ranks:
        return leaves
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))] + 1


def nearest(
    rows: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose id is divisible by ``every``."""
    listed = taking_part(rows, key, vector, lambda x: x).filter(F.exists("v", lambda x: x != 0))
    listed = materialise(listed, "vectors")
    data = without_surplus_copies(listed, k)
    tree = _fit(data, listed.count())
    if not len(tree.children):
        return listed.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.leaf(unit(lists(batch.column(1))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["id", "v", "cell"])

    data = materialise(data.select("id", "v").mapInArrow(place, "id long, v array<double>, cell int"), "leaves")
    queries = listed.filter(F.col("id") % every == 0)
    visits = _calibrated(tree, data, queries, k, recall)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = tree.leaves_by_nearness(unit(lists(batch.column(1))), visits)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], ["id", "v", "leaves"])

    routed = queries.select("id", "v").mapInArrow(choose, "id long, v array<double>, leaves array<int>")
    routed = materialise(routed.select("id", "v", F.explode("leaves").alias("cell")), "routed")
    # One row per leaf, and the number of leaves is bounded by the sample.
    sizes = {r["cell"]: r["n"] for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = {c: (n, asked[c]) for c, n in sizes.items() if c in asked}
    if not cells:
        return listed.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = in_blocks(data, routed, cells, lambda part, q: search_block(part, q, k), FOUND, BLOCK_ROWS, BLOCK_QUERIES)
    return best(found, k)
