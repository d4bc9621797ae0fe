"""Token ids in fixed-width bit packing.

A store is a folder of two Parquet tables. ``blocks`` holds one row per block of
whole documents: the shard and number of the block, how many ids of the shard lie
before it, the keys and id counts of its documents, and the ids, each in the
least number of bits that the vocabulary needs, first bit first. ``shards`` holds
one row per shard with the number of ids before it. Shards, blocks and documents
ascend by key (null first), so a global position leads to its shard, block and
bit by two searches, and any slice is unpacked alone, eight ids at a time in
numpy. A block closes at ``block_ids``; only a longer document makes a longer one.

Null and empty texts hold the end id alone. Repeated rows are stored each. Equal
keys are ordered by a hash of the text, which also spreads a key that holds a
large part of all rows. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from saltmarsh.llm.tokens import Vocabulary, encoded_slices

BLOCK_IDS = 1 << 16


def width_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def _shifts(width: int) -> Iterator[tuple[int, int, int]]:
    """(id of a group of eight, byte of the group, left shift of the id into the byte)."""
    for i in range(8):
        for byte in range(i * width // 8, ((i + 1) * width - 1) // 8 + 1):
            yield i, byte, 8 * (byte + 1) - (i + 1) * width


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    groups = -(-len(ids) // 8)
    padded = np.zeros(8 * groups, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 8)
    out = np.zeros((groups, width), np.uint8)
    for i, byte, shift in _shifts(width):
        moved = padded[:, i] << np.uint64(shift) if shift >= 0 else padded[:, i] >> np.uint64(-shift)
        out[:, byte] |= (moved & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack_bits(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block; only their bytes are read."""
    low, groups = start // 8, -(-stop // 8) - start // 8
    data = np.frombuffer(payload, np.uint8)[low * width : (low + groups) * width]
    padded = np.zeros(groups * width, np.uint8)
    padded[: len(data)] = data
    padded = padded.reshape(groups, width).astype(np.uint64)
    ids = np.zeros((groups, 8), np.uint64)
    for i, byte, shift in _shifts(width):
        part = padded[:, byte]
        ids[:, i] |= part >> np.uint64(shift) if shift >= 0 else part << np.uint64(-shift)
    ids &= np.uint64((1 << width) - 1)
    return ids.reshape(-1)[start - 8 * low : stop - 8 * low].astype(np.uint32)


def write_ids(
    docs: DataFrame,
    vocabulary: Vocabulary,
    path: str,
    end: int | None = 2,
    key: str = "doc_id",
    text: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    width = width_for(max(vocabulary.size(), (end or 0) + 1))
    key_type = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("block", T.LongType()),
            T.StructField("before", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("keys", T.ArrayType(key_type)),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        counts: list[int] = []
        waiting: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal block, before, held
            ids = np.concatenate(waiting)
            row = [[shard], [block], [before], [len(ids)], [width], [keys[:]], [counts[:]], [pack_bits(ids, width)]]
            block, before, held = block + 1, before + len(ids), 0
            keys.clear(), counts.clear(), waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], schema.names)

        types = None
        for rows, ids, bounds in encoded_slices(batches, vocabulary, end, 1):
            if types is None:
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(rows.column(0).type), pa.list_(pa.int64()), pa.binary()]
            for n, name in enumerate(rows.column(0).to_pylist()):
                size = int(bounds[n + 1] - bounds[n])
                if held and held + size > block_ids:
                    yield close()
                keys.append(name)
                counts.append(size)
                waiting.append(ids[bounds[n] : bounds[n + 1]])
                held += size
        if keys:
            yield close()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spread = [F.col("key"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*spread).sortWithinPartitions(*spread, "text")
    spark = docs.sparkSession
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # One row per shard goes through this window.
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    sizes.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base")).write.parquet(f"{path}/shards")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    blocks, shards = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/shards")
    return blocks.join(shards, "shard").withColumn("first", F.col("base") + F.col("before"))


def read_documents(spark: SparkSession, path: str, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Per document: key, start, n_tokens, ids_crc32 and, if wanted, ids, all from the files."""
    blocks = _placed(spark, path).select("first", "width", "keys", "counts", "payload")
    fields = [
        T.StructField("key", blocks.schema["keys"].dataType.elementType),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                first, width = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                names = batch.column(2)[n].values
                counts = batch.column(3)[n].values.to_numpy(zero_copy_only=False)
                bounds = np.append(0, np.cumsum(counts))
                ids = unpack_bits(batch.column(4)[n].as_py(), width, 0, int(bounds[-1]))
                data = memoryview(ids.astype("<u4").tobytes())
                ends = bounds.tolist()
                digest = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
                arrays = [names, pa.array(first + bounds[:-1]), pa.array(counts), pa.array(digest, pa.int64())]
                if keep_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    rows = blocks.mapInArrow(run, T.StructType(fields))
    return rows.withColumnRenamed("key", key)


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(position, id) of the global positions ``start`` to ``stop``; other blocks are not unpacked."""
    near = _placed(spark, path).filter((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = max(start, row["first"])
                high = min(stop, row["first"] + row["n_ids"])
                ids = unpack_bits(row["payload"], row["width"], low - row["first"], high - row["first"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), pa.array(ids.astype(np.int64))], ["position", "id"])

    return near.select("first", "n_ids", "width", "payload").mapInArrow(run, "position long, id long")
