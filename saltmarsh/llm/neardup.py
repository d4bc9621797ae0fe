"""Near-duplicate documents by consistent weighted sampling.

A text is a weighted set of shingles of five words (all words, if fewer): the
weight is the count in the text times a smoothed inverse document frequency.
Document frequencies are counted over all documents in a table of hashed slots
of fixed size, as the hashing trick does.

Improved consistent weighted sampling draws from each set samples (shingle,
step); two sets agree in a sample with the probability of their weighted Jaccard
similarity. ``ROWS`` samples make a band. Texts that share a band are candidates.
The texts of a bucket are first compared with its heads: the few that share the
most bands with others anywhere, such as the original of a family of edited
copies. Compared texts at 0.8 or more are linked, which settles most buckets: all
their texts are in one class. Buckets that still hold two classes are then
compared in full: their texts are dealt into blocks of bounded size, and a task
takes two blocks at a time and measures all pairs of different classes. So two
texts of one bucket are always compared or in one class. Classes are the
connected components of the links.

Texts that are equal byte by byte are one text up to the last step. Texts
without a word (null and empty ones too) are never copies: each is a class of
its own. Repeated rows belong to one class. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from saltmarsh.llm.components import components
from saltmarsh.llm.words import mix, word_hashes
from saltmarsh.llm.worker import process_cache, slices
from saltmarsh.operators.rows import materialise

WORDS = 5
SIMILARITY = 0.8
BANDS = 14
ROWS = 3
HEADS = 4
# Texts and shingles of a bucket that one block holds on average, at most.
BLOCK_TEXTS = 1 << 10
BLOCK_SHINGLES = 1 << 20
# (text, text) pairs with a common shingle that are added up at a time.
PAIRED = 1 << 21
SLOT_BITS = 20
# Slots that travel in one row while document frequencies are added up.
CHUNK_SLOTS = 1 << 12
# Shingles that are sampled at a time, so that all arrays stay in the processor's cache.
CACHED = 1 << 15


def shingles(words: np.ndarray) -> np.ndarray:
    """Shingle hashes of the word hashes of one text, in ascending order, repeated ones too."""
    size = min(WORDS, len(words))
    if not size:
        return words
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - size + 1, np.uint64)
        factor = np.uint64(1)
        for i in range(size):
            factor *= np.uint64(0xC2B2AE3D27D4EB4F)
            total += words[i : i + len(total)] * factor
        total = mix(total)
    total.sort()
    return total


def distinct(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts."""
    first = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)
    return sorted_values[first], np.diff(np.append(first, len(sorted_values)))


def slots(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of texts with words, and for every slot the number of texts with a shingle in it.

    Each task adds up its own texts; the sums meet in tasks that each own some
    slots and read them one row at a time. The result has a fixed size.
    """
    chunks = (1 << SLOT_BITS) // CHUNK_SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SLOT_BITS, np.int64)
        texts = 0
        for batch in batches:
            for block in slices(batch, 0, 2 << 20):
                words, bounds, _ = word_hashes(block.column(0))
                parts = [np.unique(slots(shingles(words[a:b]))) for a, b in zip(bounds, bounds[1:]) if b > a]
                texts += len(parts)
                if parts:
                    table += np.bincount(np.concatenate(parts), minlength=len(table))
        numbers = [-1, *range(chunks)]
        values = [np.array([texts]).tobytes()] + [c.astype("<i4" if texts < 1 << 31 else "<i8").tobytes() for c in table.reshape(chunks, -1)]
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wide = number < 0 or len(raw) == 8 * CHUNK_SLOTS
                sums[number] = sums.get(number, 0) + np.frombuffer(raw, "<i8" if wide else "<i4").astype(np.int64)
        for number, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    summed = docs.select(F.lower(text)).mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema)
    table, texts = np.zeros(1 << SLOT_BITS, np.int64), 0
    for row in summed.collect():
        values = np.frombuffer(bytes(row["counts"]), np.int64)
        if row["chunk"] < 0:
            texts = int(values[0])
        else:
            table[row["chunk"] * CHUNK_SLOTS : (row["chunk"] + 1) * CHUNK_SLOTS] = values
    return texts, table


def inverse_frequencies(texts: int, table: np.ndarray) -> np.ndarray:
    """Between 1 (in every text) and 2 (in none)."""
    return (1 + np.log((1 + texts) / (1 + table)) / math.log(2 + texts)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling.

    Each (shingle, sample) pair owns 64 random bits: r and c are gamma(2, 1), b is
    uniform. With t = floor(ln w / r + b), the pair (shingle, t) with the least
    ln c - r (t - b + 1) is the sample.
    """

    def __init__(self, samples: int) -> None:
        unit = (np.arange(1 << 16) + 0.5) / (1 << 16)
        self.minus_log = -np.log(unit).astype(np.float32)
        # Gamma(2, 1) at each unit value: its distribution function is 1 - (1 + x) exp(-x).
        grid = np.linspace(0, 40, 400_001)
        self.gamma = np.interp(unit, 1 - (1 + grid) * np.exp(-grid), grid).astype(np.float32)
        self.unit = unit.astype(np.float32)
        self.salts = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sample(self, values: np.ndarray, logs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hash of every sample of every set; sets lie one after another and are not empty."""
        lengths = np.diff(np.append(starts, len(values)))
        owner = np.repeat(np.arange(len(starts)), lengths)
        out = np.empty((len(starts), len(self.salts)), np.uint64)
        best = np.empty(len(starts), np.int64)
        with np.errstate(over="ignore"):
            for k, salt in enumerate(self.salts):
                bits = mix(values ^ salt).view(np.uint16).reshape(-1, 4)
                r = self.gamma[bits[:, 2]]
                b = self.unit[bits[:, 3]]
                t = np.floor(logs / r + b)
                cost = np.log(self.minus_log[bits[:, 0]] + self.minus_log[bits[:, 1]]) - r * (t - b + 1)
                hits = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, starts), lengths))[::-1]
                best[owner[hits]] = hits
                out[:, k] = mix(values[best] + t[best].astype(np.int64).view(np.uint64) * salt)
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            keys[:, band] = np.uint64(band)
            for k in range(band * ROWS, (band + 1) * ROWS):
                keys[:, band] = mix(keys[:, band] * np.uint64(0x9E3779B97F4A7C15) + samples[:, k])
    return keys


def text_id(text: str) -> Column:
    """Sixteen bytes that stand for the text."""
    return F.unhex(F.md5(F.col(text)))


def _own_id(text: str) -> Column:
    return F.coalesce(text_id(text), F.unhex(F.md5(F.lit(""))))


def signatures(docs: DataFrame, weights: np.ndarray, key: str, text: str) -> DataFrame:
    """key, text id and band keys (null for a text without words) of every row."""
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("uid", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = process_cache("hashes", ("sampler", BANDS * ROWS), lambda: Sampler(BANDS * ROWS))
        for batch in batches:
            for block in slices(batch, 2, 2 << 20):
                words, bounds, _ = word_hashes(block.column(2))
                full = np.flatnonzero(np.diff(bounds))
                keys = np.empty((len(full), BANDS), np.uint64)
                n = 0
                while n < len(full):
                    values, logs, starts, size, first = [], [], [], 0, n
                    while n < len(full) and (n == first or size < CACHED):
                        found, counts = distinct(shingles(words[bounds[full[n]] : bounds[full[n] + 1]]))
                        starts.append(size)
                        values.append(found)
                        logs.append(np.log(counts * weights[slots(found)]))
                        size, n = size + len(found), n + 1
                    logs = np.concatenate(logs).astype(np.float32)
                    keys[first:n] = band_keys(sampler.sample(np.concatenate(values), logs, np.array(starts)))
                filled = np.zeros(block.num_rows, bool)
                filled[full] = True
                offsets = np.append(0, np.cumsum(filled * BANDS))
                bands = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32(), mask=np.append(~filled, False)), pa.array(keys.reshape(-1).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), bands], schema.names)

    rows = docs.select(F.col(key).alias("key"), _own_id(text).alias("uid"), F.lower(text).alias("text"))
    return rows.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """uid and the low 32 bits of all shingles, ascending, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, 1, 2 << 20):
                words, bounds, _ = word_hashes(block.column(1))
                parts = [np.sort(shingles(words[a:b]).astype(np.uint32)) for a, b in zip(bounds, bounds[1:])]
                raw = [p.astype("<u4").tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(raw, pa.binary())], ["uid", "shingles"])

    return docs.select("uid", F.lower("text")).mapInArrow(run, "uid binary, shingles binary")


def weighted_jaccard(left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> float:
    """Of two ascending shingle arrays with repeats."""
    both, side = np.concatenate([left, right]), np.repeat([0, 1], [len(left), len(right)])
    values, place = np.unique(both, return_inverse=True)
    counts = np.bincount(place * 2 + side, minlength=2 * len(values)).reshape(-1, 2)
    w = weights[slots(values)].astype(np.float64)
    most = float((counts.max(1) * w).sum())
    return float((counts.min(1) * w).sum()) / most if most else 0.0


def verified(edges: DataFrame, sets: DataFrame, weights: np.ndarray, least: float) -> DataFrame:
    """The edges (a, b) whose texts have the least similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for left, right in zip(batch.column(2), batch.column(3)):
                pair = (np.frombuffer(x.as_buffer(), "<u4") for x in (left, right))
                kept.append(weighted_jaccard(*pair, weights) >= least)
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    left = edges.join(sets.select(F.col("uid").alias("a"), F.col("shingles").alias("left")), "a")
    pairs = left.join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("right")), "b")
    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


def overlaps(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: np.ndarray, cols: np.ndarray, texts: int) -> np.ndarray:
    """Weight of the common elements of each text of ``rows`` with each of ``cols``.

    Pairs (owner, element) are distinct; ``weight`` is that of the element. Elements
    of many texts are taken by a matrix product, others text by text.
    """
    size = np.bincount(element, minlength=len(weight))
    out = np.zeros((len(rows), len(cols)))
    at_row, at_col = np.full(texts, -1), np.full(texts, -1)
    at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
    common = np.flatnonzero(size > max(2, texts // 8))
    width = max(1, PAIRED // max(1, texts))
    number = np.full(len(weight), -1)
    number[common] = np.arange(len(common))
    wide = number[element] >= 0
    wide_owner, wide_number = owner[wide], number[element[wide]]
    for start in range(0, len(common), width):
        part = common[start : start + width]
        inside = (wide_number >= start) & (wide_number < start + len(part))
        held = np.zeros((texts, len(part)))
        held[wide_owner[inside], wide_number[inside] - start] = 1
        out += (held[rows] * weight[part]) @ held[cols].T
    left = np.flatnonzero(~wide & (size[element] > 1) & (at_row[owner] >= 0))
    right = np.flatnonzero(~wide & (size[element] > 1) & (at_col[owner] >= 0))
    right = right[np.argsort(element[right], kind="stable")]
    held = np.bincount(element[right], minlength=len(weight))
    first = np.cumsum(held) - held
    ends = np.cumsum(held[element[left]])
    flat, start = out.reshape(-1), 0
    while start < len(left):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRED, "right")))
        some = left[start:stop]
        times = held[element[some]]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[element[some]], times)
        cell = np.repeat(at_row[owner[some]], times) * len(cols) + at_col[owner[right[place]]]
        flat += np.bincount(cell, np.repeat(weight[element[some]], times), len(flat))
        start = stop
    return out


def block_links(sets: list[np.ndarray], classes: np.ndarray, side: np.ndarray, weights: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of texts that tie together all classes with a pair at the least similarity or more.

    Ascending shingle arrays with repeats. With texts on both sides, those of side 0
    are compared with those of side 1, else all with all. At most one link fewer than classes.
    """
    if len(sets) < 2 or (classes == classes[0]).all():
        return []
    if side.any() and not side.all():
        rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side)
    else:  # one of two texts of different classes is not in the largest class
        rows, cols = np.flatnonzero(classes != np.bincount(classes).argmax()), np.arange(len(sets))
    lengths = np.array([len(s) for s in sets])
    owner, shingle = np.repeat(np.arange(len(sets)), lengths), np.concatenate(sets)
    # The nth occurrence of a shingle is an element of its own, so common counts are common elements.
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1]))[: len(shingle)]
    run = np.flatnonzero(new)
    nth = np.arange(len(shingle)) - np.repeat(run, np.diff(np.append(run, len(shingle))))
    values, element = np.unique(shingle.astype(np.uint64) << np.uint64(32) | nth.astype(np.uint64), return_inverse=True)
    weight = weights[slots(values >> np.uint64(32))].astype(np.float64)
    total = np.bincount(owner, weight[element], len(sets))
    both = overlaps(owner, element, weight, rows, cols, len(sets))
    root, links = classes.copy(), []
    for row, common in zip(rows.tolist(), both):
        alike = common / np.maximum(total[row] + total[cols] - common, 1e-300)
        near = np.flatnonzero((alike >= least - 1e-9) & (root[cols] != root[row]))
        for place in near.tolist():
            col = int(cols[place])
            if root[col] == root[row] or alike[place] < least + 1e-9 and weighted_jaccard(sets[row], sets[col], weights) < least:
                continue
            links.append((row, col))
            root[root == root[col]] = root[row]
    return links


def compared_in_full(members: DataFrame, known: DataFrame, sets: DataFrame, weights: np.ndarray, least: float) -> DataFrame | None:
    """Links (a, b) between the classes of each bucket; none if no bucket is open.

    A bucket of up to HEADS + 1 texts had all its pairs compared, and one of a
    single class needs no more links.
    """
    large = members.filter(F.col("texts") > HEADS + 1).select("bucket", "uid")
    large = large.join(known, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    large = large.join(sets.select("uid", (F.length("shingles") / 4).cast("long").alias("size")), "uid")
    large = materialise(large, "large")
    around = large.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")
    )
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    still = materialise(around.filter("low <> high").select("bucket", blocks.alias("blocks")), "open")
    if still.isEmpty():
        return None
    # A text meets every block of its bucket, in the job of the two.
    own = F.pmod(F.xxhash64("uid", "bucket"), "blocks")
    jobs = large.join(still, "bucket").withColumn("own", own)
    jobs = jobs.select("bucket", "uid", "label", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    jobs = jobs.select(
        "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "uid", "label",
    )
    jobs = jobs.join(sets, "uid")

    def run(table: pa.Table) -> pa.Table:
        uids = table.column("uid").to_pylist()
        held = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("shingles")]
        _, classes = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
        found = block_links(held, classes, table.column("side").to_numpy(), weights, least)
        return pa.table({c: pa.array([uids[pair[i]] for pair in found], pa.binary()) for i, c in enumerate("ab")})

    return jobs.groupBy("bucket", "low", "high").applyInArrow(run, "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """key, text_id and class_id (the least key of the class) of every row."""
    weights = inverse_frequencies(*document_frequencies(docs, text))
    rows = materialise(signatures(docs, weights, key, text), "signatures")
    worded = rows.filter(F.col("bands").isNotNull())

    # One row per text and band; buckets that hold more than one text.
    texts = worded.groupBy("uid").agg(F.first("bands").alias("bands"), F.min("key").alias("key"))
    members = texts.select("uid", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    members = materialise(members.join(materialise(sizes, "buckets"), "bucket"), "members")

    # Every member beside the heads of its bucket.
    standing = materialise(members.groupBy("uid").agg(F.sum("texts").alias("standing")), "standing")
    place = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("standing"), "uid"))
    heads = members.join(standing, "uid").withColumn("place", place).filter(F.col("place") <= HEADS)
    heads = materialise(heads.select("bucket", F.col("uid").alias("head")), "heads")
    pairs = members.join(heads, "bucket").filter("uid <> head")
    pairs = pairs.select(F.greatest("uid", "head").alias("a"), F.least("uid", "head").alias("b")).distinct()

    # The shingles of their texts, each text once: one row that holds it is looked up by key and text.
    wanted = members.select("uid").distinct().join(worded.groupBy("uid").agg(F.min("key").alias("key")), "uid")
    held = docs.select(F.col(key).alias("key"), text_id(text).alias("uid"), F.col(text).alias("text"))
    same = (F.col("h.uid") == F.col("w.uid")) & F.col("h.key").eqNullSafe(F.col("w.key"))
    found = held.alias("h").join(wanted.alias("w"), same, "left_semi")
    sets = materialise(shingle_sets(found.dropDuplicates(["uid", "key"])), "shingles")

    links = materialise(verified(pairs, sets, weights, similarity), "links")
    labels = materialise(components(links, "a", "b"), "labels")
    more = compared_in_full(members, labels.withColumnRenamed("node", "uid"), sets, weights, similarity)
    if more is not None:
        more = materialise(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), "links")
        labels = materialise(components(more, "a", "b"), "labels")
    known = labels.withColumnRenamed("node", "uid")
    classed = worded.select("key", "uid").join(known, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    classed = materialise(classed, "classed")
    least = materialise(classed.groupBy("label").agg(F.min("key").alias("class_id")), "classes")
    grouped = classed.join(least, "label").select("key", F.col("uid").alias("text_id"), "class_id")
    alone = rows.filter(F.col("bands").isNull()).select("key", F.col("uid").alias("text_id"), F.col("key").alias("class_id"))
    return grouped.union(alone).withColumnRenamed("key", key)


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one row of every class: that of the least key, and of its texts the least id.

    Texts without a word are classes of their own by key and text, so repeated rows
    among them go as well.
    """
    classes = near_duplicates(docs, key, text, similarity)
    chosen = F.struct(F.col(key).alias("key"), F.col("text_id").alias("uid"))
    worded = F.col("text_id") != F.unhex(F.md5(F.lit("")))
    group = F.struct(F.col("class_id"), F.when(F.col("class_id").isNull() | ~worded, F.col("text_id")))
    kept = classes.groupBy(group.alias("group")).agg(F.min(chosen).alias("chosen")).select("chosen.key", "chosen.uid").distinct()
    kept = materialise(kept, "kept").alias("kept")
    # Columns of docs travel in one struct, whatever their names are.
    rows = docs.select(F.col(key).alias("key"), _own_id(text).alias("uid"), F.struct(*docs.columns).alias("row")).alias("docs")
    same = (F.col("docs.uid") == F.col("kept.uid")) & F.col("docs.key").eqNullSafe(F.col("kept.key"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["key", "uid"]).select("row.*")
