"""Best-fit decreasing packing of token sequences into windows.

Documents longer than a window are first cut into full windows. What remains of
each document is one piece shorter than a window. Best fit takes pieces by
falling length and puts each into the tightest open window that still has room;
pieces of one length are alike, so the whole packing follows from how many
pieces there are of each length. That histogram (one row per length, at most
``window`` rows) is all the driver sees: a segment tree indexed by remaining
capacity finds the tightest window, and windows alike are kept as one run. The
outcome is a short list of runs, "the pieces ``rank`` and on of length L go to
the windows ``sequence`` and on, from ``offset`` on", which every task applies to
its own pieces. A length, source or document that holds most rows is spread
like any other, since only ranks are needed and these are counted per task.

Null and empty texts hold the end id alone. Repeated rows are packed each on its
own; equal pieces may trade places, which changes nothing but their window.
Columns other than the key and the text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from saltmarsh.llm.tokens import Vocabulary, encoded_slices
from saltmarsh.operators.rows import materialise


class CapacityTree:
    """Segment tree over remaining capacities: which ones some open window has."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, remaining: int, present: bool) -> None:
        node = remaining + self.leaves
        self.any[node] = present
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, needed: int) -> int | None:
        """The least remaining capacity that is not below ``needed``."""
        node = needed + self.leaves
        if self.any[node]:
            return needed
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def plan_runs(histogram: dict[int, int], window: int) -> np.ndarray:
    """Best-fit decreasing over counts per length.

    Rows (length, rank, sequence, offset, each): pieces of this length from this
    rank on lie ``each`` to a window, from that window and offset on, up to the
    rank of the next row of the length. The windows are those that best fit would
    choose piece by piece: the tightest window stays the tightest while it takes
    more pieces of the same length.
    """
    tree = CapacityTree(window)
    open_runs: dict[int, list[tuple[int, int]]] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(remaining: int, first: int, count: int) -> None:
        if count and remaining:
            if not open_runs.setdefault(remaining, []):
                tree.set(remaining, True)
            open_runs[remaining].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = window, sequences
                count = -(-left // (window // length))
                sequences += count
            else:
                first, count = open_runs[room].pop()
                if not open_runs[room]:
                    tree.set(room, False)
            each = room // length
            whole = min(count, left // each)
            if whole:
                rows.append((length, rank, first, window - room, each))
                put(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < count:  # fewer pieces than fit into one window
                rows.append((length, rank, first + whole, window - room, each))
                put(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(room, first + whole, count - whole)
    return np.array(rows, np.int64).reshape(-1, 5)


def cut_pieces(
    docs: DataFrame,
    vocabulary: Vocabulary,
    window: int,
    end: int | None,
    key: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of every document with their part and, per part and length, their rank."""
    fields = [T.StructField("key", docs.schema[key].dataType)] + [
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "part", "rank")
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for rows, ids, bounds in encoded_slices(batches, vocabulary, end, 1):
            total = np.diff(bounds)
            cuts = -(-total // window)
            doc = np.repeat(np.arange(len(total)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
            length = np.minimum(total[doc] - start, window)
            first = bounds[:-1][doc] + start
            data = ids.astype("<u4").tobytes()
            digest = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            alike = length[order]
            run_start = np.searchsorted(alike, alike)
            rank = np.empty(len(doc), np.int64)
            rank[order] = seen[alike] + np.arange(len(doc)) - run_start
            seen += np.bincount(length, minlength=window + 1)
            arrays = [rows.column(0).take(pa.array(doc))] + [
                pa.array(x, pa.int64()) for x in (start, length, digest, total[doc], np.full(len(doc), part), rank)
            ]
            if keep_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields))


def pack(
    docs: DataFrame,
    vocabulary: Vocabulary,
    window: int = 2048,
    end: int | None = 1,
    key: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Every piece with its sequence and offset: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``keep_ids`` adds the ids of the piece. Pieces are written once to the shared
    folder, so that ranks stay what they were when an executor is lost.
    """
    pieces = materialise(cut_pieces(docs, vocabulary, window, end, key, text, keep_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("pieces"))
    # One row per length: the histogram that the plan is made from.
    totals = {r["length"]: r["total"] for r in counts.groupBy("length").agg(F.sum("pieces").alias("total")).collect()}
    runs = plan_runs(totals, window)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("part", "shift")
    schema = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = ranked.columns
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ranks stay far below 2 ** 50, lengths below 2 ** 13.
        keys = (runs[:, 0] << 50) | runs[:, 1]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            row = runs[np.searchsorted(keys, (length << 50) | rank, "right") - 1]
            place = rank - row[:, 1]
            added = [pa.array(row[:, 2] + place // row[:, 4]), pa.array(row[:, 3] + place % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, "sequence_id", "offset"])

    packed = ranked.mapInArrow(run, schema)
    kept = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if keep_ids else [])
    return packed.select(F.col("key").alias(key), *kept)
