"""Removal of repeated byte strings with a distributed, sparse suffix sort.

Every text is a row of bytes; a *window* is a string of ``LENGTH`` bytes in it. A
window is a repeat if the same string starts at a smaller (document id, offset),
and every byte that a repeat covers is removed. Whether a window is a repeat is
judged on the input alone.

A suffix per byte would weigh many times the texts, so suffixes are sorted in two
rounds, the first over few of them:

1. Each window owns an anchor, its string of ``ANCHOR`` bytes with the least hash;
   equal windows own equal anchors. A run of windows with one anchor is a *cell*,
   about one for thirty bytes. The suffix at a cell has two leading tokens, the hash
   of its anchor and that of all its bytes. Sampled splitters deal suffixes in
   ranges of (anchor, content, document, offset), so that copies of one passage
   are spread over many buckets. A bucket sorts its suffixes by multikey
   quicksort. A cell that follows an equal one consists of repeats. The first cell
   of a bucket is compared with the last one of the buckets before it.
2. What is left open are first cells whose anchor has other contents too, where
   passages begin and end, or stands in the cell twice, as in short periods: a few in a
   hundred. Their bytes are dealt in ranges of
   anchors, and all their windows sorted by multikey quicksort over words of eight
   bytes. Anchors with more than ``HOT`` open cells are not sorted in one place:
   their windows become suffixes of length one, with two tokens of their bytes, and
   pass through the first round again.

Null and empty texts have no bytes. Rows that share a document id are one place:
of equal strings at equal offsets there, neither is the earlier. A null id counts
as the least. Rows equal in all columns get equal results. Columns other than the
id and the text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from saltmarsh.llm.words import CHUNK, Powers, mix, text_bytes
from saltmarsh.llm.worker import process_cache, slices
from saltmarsh.operators.rows import materialise

LENGTH = 100
ANCHOR = 40
# Windows of one cell at most.
CELL = 64
# Open cells of one anchor that are sorted in one place.
HOT = 4096
# Text behind one bucket of the first round, at most on average.
BUCKET_BYTES = 64 << 20
# Suffixes that a task gathers before it deals them, and text and suffixes behind the splitters.
GATHERED = 1 << 20
SAMPLE_BYTES = 24 << 20
SAMPLED = 1 << 15
# Below this size a part of a multikey quicksort is sorted by all its words at once.
SMALL = 1 << 12
# Length of a window in the second round: starts of its words of eight bytes, the last two overlap.
WORDS = (*range(0, LENGTH - 8, 8), LENGTH - 8)

# Bit of a cell's content hash that says that its anchor stands in it more than once.
SELF = np.uint64(1)

NULL_ID = -(1 << 63)
DUPLICATE, OPEN_CELL, FIRST, LAST = range(4)
OUTCOME = "kind byte, bucket int, anchor long, content long, doc long, tie long, start long, length int"

Suffixes = tuple[np.ndarray, ...]  # anchor, content, doc, start, tie, length
Words = Callable[[np.ndarray], np.ndarray]


def multikey_order(rows: int, words: list[Words]) -> np.ndarray:
    """Row numbers in the order of their words, by three-way quicksort word after word.

    ``words[k]`` gives word k of some rows. A part whose rows agree in a word goes
    on with the next word alone.
    """
    order = np.arange(rows)
    parts = [(0, rows, 0)]
    while parts:
        low, high, depth = parts.pop()
        while depth < len(words) and high - low > SMALL:
            part = order[low:high]
            keys = words[depth](part)
            pivot = np.partition(keys[:: max(1, len(keys) // 31)], 15)[15]
            less, more = keys < pivot, keys > pivot
            equal = ~(less | more)
            below, same = int(less.sum()), int(equal.sum())
            order[low:high] = np.concatenate([part[less], part[equal], part[more]])
            parts += [(low, low + below, depth), (low + below + same, high, depth)]
            low, high, depth = low + below, low + below + same, depth + 1
        if depth < len(words) and high - low > 1:
            part = order[low:high]
            first = words[depth](part)
            part = part[np.argsort(first, kind="stable")]
            first = np.sort(first)
            tied = np.zeros(len(part), bool)
            tied[1:] = first[1:] == first[:-1]
            tied[:-1] |= tied[1:]
            if depth + 1 < len(words) and tied.any():
                some = part[tied]
                part[tied] = some[np.lexsort([w(some) for w in words[:depth:-1]] + [first[tied]])]
            order[low:high] = part
    return order


def buckets(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters are less than each key; keys and splitters are columns, the leading one first."""
    low = np.searchsorted(splitters[0], keys[0], "left")
    high = np.searchsorted(splitters[0], keys[0], "right")
    if len(keys) > 1:
        torn = np.flatnonzero(low < high)
        starts = low[torn]
        for start in np.unique(starts):
            some = torn[starts == start]
            stop = high[some[0]]
            low[some] = start + buckets([k[some] for k in keys[1:]], [s[start:stop] for s in splitters[1:]])
    return low


def _sums(data: np.ndarray) -> tuple[np.ndarray, Powers]:
    powers = process_cache("hashes", "powers", Powers)
    powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(powers.byte[data] * powers.up[: len(data)], out=sums[1:])
    return sums, powers


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def cells(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, windows, anchor hash and content hash of all cells of texts that lie one after another."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    with np.errstate(over="ignore"):
        sums, powers = _sums(data)
        hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers.down[: len(data) - ANCHOR + 1])
        least = _least(hashes, LENGTH - ANCHOR + 1)
        whole = np.arange(LENGTH, len(data) + 1) <= np.repeat(bounds[1:], np.diff(bounds))[: len(least)]
        goes_on = np.zeros(len(least), bool)
        goes_on[1:] = whole[1:] & whole[:-1] & (least[1:] == least[:-1])
        first = np.flatnonzero(whole & ~goes_on)
        last = np.flatnonzero(whole & ~np.append(goes_on[1:], False))
        pieces = (last - first) // CELL + 1
        start = np.repeat(first, pieces)
        start += CELL * (np.arange(len(start)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        windows = np.minimum(np.repeat(last, pieces) - start + 1, CELL)
        stop = start + windows + LENGTH - 1
        content = mix((sums[stop] - sums[start]) * powers.down[start] + windows.astype(np.uint64))
        content = content & ~SELF | _repeat_inside(hashes, least, start, windows)
        return start, windows, mix(least[start]) >> np.uint64(16), content


def _repeat_inside(hashes: np.ndarray, least: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """``SELF`` for cells in which the anchor stands twice, as it must where two windows of a cell are equal; else 0."""
    reach = LENGTH - ANCHOR
    # Of the windows that hold a place, the greatest anchor hash; the place is an anchor if its own hash is that one.
    padded = np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)])
    place = np.flatnonzero(~_least(~padded, reach + 1) == hashes)
    order = place[np.lexsort([place, hashes[place]])]
    near = np.flatnonzero((hashes[order][1:] == hashes[order][:-1]) & (np.diff(order) < CELL + reach))
    if not len(near) or not len(start):
        return np.zeros(len(start), np.uint64)
    # The first place of the anchor at or behind a cell's start, and the next place of the same anchor.
    some = np.flatnonzero(np.isin(least[start], hashes[order[near]]))
    ranks = np.unique(hashes[order], return_inverse=True)
    width = len(hashes) + 1
    keys = ranks[1] * width + order
    first = np.searchsorted(keys, np.searchsorted(ranks[0], least[start[some]]) * width + start[some])
    stop = start[some] + windows[some] + reach
    following = np.minimum(first + 1, len(order) - 1)
    twice = (following > first) & (hashes[order[following]] == least[start[some]]) & (order[following] < stop)
    found = np.zeros(len(start), np.uint64)
    found[some[twice]] = SELF
    return found


def text_suffixes(batch: pa.RecordBatch) -> Iterator[Suffixes]:
    """Cells of the texts of (doc, tie, text) rows, about a million bytes at a time."""
    for block in slices(batch, 2, CHUNK):
        data, bounds = text_bytes(block.column(2))
        doc, tie = (block.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        # Longer texts alone in their block are cut; the cut leaves every window whole in one piece.
        step = CHUNK if block.num_rows == 1 else max(len(data), 1)
        for low in range(0, len(data), step):
            inside = np.clip(bounds - low, 0, step + LENGTH - 1)
            start, windows, anchor, content = cells(data[low : low + step + LENGTH - 1], inside)
            row = np.searchsorted(inside, start, "right") - 1
            yield anchor, content, doc[row], start + low - bounds[row], tie[row], windows


def _pack(parts: list[Suffixes]) -> pa.RecordBatch | None:
    """Suffixes by bucket, each bucket's as one compressed row. The parts hold the bucket as their last column."""
    anchor, content, doc, start, tie, windows, bucket = (np.concatenate(c) for c in zip(*parts))
    if not len(anchor):
        return None
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
    rows = []
    for low, high in zip(cut, [*cut[1:], len(order)]):
        at = order[low:high]
        new = np.append(True, (np.diff(doc[at]) != 0) | (np.diff(tie[at]) != 0))
        raw = b"".join(
            [
                struct.pack("<qq", len(at), int(new.sum())),
                content[at].tobytes(),
                anchor[at].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                doc[at][new].astype("<i8").tobytes(),
                tie[at][new].astype("<i8").tobytes(),
                np.diff(np.append(np.flatnonzero(new), len(at))).astype("<u4").tobytes(),
                (start[at] & 0xFFFFFFFF).astype("<u4").tobytes(),
                (start[at] >> 32).astype("<u4").tobytes(),
                windows[at].astype(np.uint8).tobytes(),
            ]
        )
        rows.append((bucket[at[0]], len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
        ["bucket", "size", "body"],
    )


def _unpack(size: int, body: bytes) -> Suffixes:
    raw = pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True)
    count, docs = struct.unpack_from("<qq", raw)
    at = 16

    def take(kind, number: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, number, at)
        at += found.nbytes
        return found

    content = take("<u8", count)
    anchor = np.zeros((count, 8), np.uint8)
    anchor[:, :6] = take(np.uint8, 6 * count).reshape(-1, 6)
    doc, tie, counts = take("<i8", docs), take("<i8", docs), take("<u4", docs)
    start = take("<u4", count).astype(np.int64)
    start += take("<u4", count).astype(np.int64) << 32
    return anchor.view("<u8").reshape(-1), content, np.repeat(doc, counts), start, np.repeat(tie, counts), take(np.uint8, count)


def _judge(bucket: int, suffixes: Suffixes) -> pa.RecordBatch:
    """Outcome of one bucket: repeats, open first cells, and its edges for the comparison with other buckets."""
    order = multikey_order(len(suffixes[0]), [lambda at, c=c: c[at] for c in suffixes[:5]])
    anchor, content, doc, start, tie, windows = (c[order] for c in suffixes)
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new = new_anchor.copy()
    new[1:] |= content[1:] != content[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    repeat = (doc != doc[first]) | (start != start[first])
    group = np.cumsum(new_anchor) - 1
    contents = np.bincount(group[new])
    # The anchor at either edge may go on in another bucket.
    contents[[0, -1]] = 2
    # Texts of one document id may share the first place; each is opened once.
    other = np.append(True, tie[1:] != tie[:-1]) | new
    open_cell = other & ~repeat & ((contents[group] > 1) | (content & SELF > 0))
    edge = (first == 0) & ~repeat
    chosen = [np.flatnonzero(m) for m in (repeat, open_cell, edge)] + [np.array([len(order) - 1])]
    at = np.concatenate(chosen)
    kind = np.repeat(np.arange(4, dtype=np.int8), [len(c) for c in chosen])
    columns = [kind, np.full(len(at), bucket, np.int32), anchor[at].view(np.int64), content[at].view(np.int64)]
    columns += [doc[at], tie[at], start[at], windows[at].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in OUTCOME.split(", ")])


def _splitters(rows: DataFrame, suffixes: Callable, share: float, number: int) -> list[np.ndarray]:
    """Columns of ``number - 1`` splitters at most, from a sample of rows and about ``SAMPLED`` of their suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in suffixes(batch):
                some = [c[::16] for c in found[:4]]
                some[:2] = [c.view(np.int64) for c in map(np.ascontiguousarray, some[:2])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in some], ["anchor", "content", "doc", "start"])

    some = rows if share >= 1 else rows.sample(share, seed=7)
    sample = some.mapInArrow(run, "anchor long, content long, doc long, start long")
    # A hash of the place thins further, should many texts be longer than expected.
    found = sample.orderBy(F.xxhash64("doc", "start")).limit(SAMPLED).toArrow()
    columns = [found.column(k).to_numpy() for k in range(4)]
    columns[:2] = [c.view(np.uint64) for c in columns[:2]]
    order = np.lexsort(columns[::-1])
    chosen = order[np.arange(1, number) * len(order) // number] if len(order) else order
    return [c[chosen] for c in columns]


def _decided(rows: DataFrame, suffixes: Callable, share: float, number: int) -> DataFrame:
    """Outcome of all suffixes of the rows; first cells of a bucket that repeat are added as repeats."""
    splitters = _splitters(rows, suffixes, share, number)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for found in suffixes(batch):
                parts.append((*found, buckets(list(found[:4]), splitters)))
                held += len(found[0])
                if held >= GATHERED:
                    yield _pack(parts)
                    parts, held = [], 0
        if held:
            yield _pack(parts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Suffixes]] = {}
        for batch in batches:
            for bucket, size, body in zip(*(batch.column(k) for k in range(3))):
                held.setdefault(bucket.as_py(), []).append(_unpack(size.as_py(), body.as_buffer()))
        while held:
            bucket, parts = held.popitem()
            yield _judge(bucket, tuple(np.concatenate(c) for c in zip(*parts)))

    dealt = rows.mapInArrow(deal, "bucket int, size long, body binary").repartitionById(number, "bucket")
    outcome = materialise(dealt.mapInArrow(judge, OUTCOME), "suffixes")
    # One row per bucket: what the last bucket before it that holds anything ends with.
    before = W.orderBy("bucket")
    ends = outcome.filter(F.col("kind") == LAST).select(
        "bucket", F.lag("anchor").over(before).alias("_anchor"), F.lag("content").over(before).alias("_content")
    )
    edges = outcome.filter(F.col("kind") == FIRST).join(ends, "bucket")
    late = edges.filter("anchor = _anchor AND content = _content").select(outcome.columns)
    return outcome.filter(F.col("kind") < FIRST).union(late.withColumn("kind", F.lit(DUPLICATE).cast("byte")))


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Bytes of the open cells of a batch, and cell, place and offset of all their windows."""
    data, bounds = text_bytes(batch.column(batch.schema.get_field_index("bytes")))
    count = np.diff(bounds) - LENGTH + 1
    cell = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
    return data, cell, bounds[cell] + inside, batch.column("start").to_numpy()[cell] + inside


def window_suffixes(batch: pa.RecordBatch) -> Iterator[Suffixes]:
    """Suffixes of length one, a window each, with two tokens of its bytes, of open cells."""
    for block in slices(batch, batch.schema.get_field_index("bytes"), CHUNK):
        data, cell, place, start = _windows(block)
        doc, tie = (block.column(k).to_numpy()[cell] for k in ("doc", "tie"))
        with np.errstate(over="ignore"):
            sums, powers = _sums(data)
            one = mix((sums[place + LENGTH] - sums[place]) * powers.down[place])
            other = np.cumsum(np.append(np.uint64(0), mix(powers.byte)[data] * powers.up[: len(data)]))
            two = mix((other[place + LENGTH] - other[place]) * powers.down[place])
        yield one >> np.uint64(16), two & ~SELF, doc, start, tie, np.ones(len(doc), np.int64)


def _window_repeats(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Runs of windows of the open cells that repeat an earlier window of them."""
    data, cell, place, start = _windows(batch)
    doc, tie = (batch.column(k).to_numpy()[cell] for k in ("doc", "tie"))
    every = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1))
    # Eight bytes from each place on, the first byte weighing most.
    eight = np.ascontiguousarray(every).view(">u8").reshape(-1).astype(np.uint64)
    words: list[Words] = [lambda at, k=k: eight[place[at] + k] for k in WORDS]
    order = multikey_order(len(place), [*words, lambda at: doc[at], lambda at: start[at]])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for word in words:
        values = word(order)
        new[1:] |= values[1:] != values[:-1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    repeat = np.zeros(len(order), bool)
    repeat[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    at = np.flatnonzero(repeat)
    begins = np.append(True, (np.diff(at) != 1) | (np.diff(cell[at]) != 0)) if len(at) else np.zeros(0, bool)
    head = at[begins]
    length = np.diff(np.append(np.flatnonzero(begins), len(at))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[head], tie[head], start[head], length)], ["doc", "tie", "start", "length"])


def _sort_open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open cells in the order of their anchors; whole anchors are taken together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            anchor = batch.column("anchor").to_numpy()
            if sum(b.num_rows for b in held) >= HOT:
                stop = int(np.searchsorted(anchor, held[-1].column("anchor")[-1].as_py(), "right"))
                held.append(batch.slice(0, stop))
                if stop < batch.num_rows:
                    yield _window_repeats(pa.concat_batches(held))
                    held = []
            else:
                stop = min(HOT, batch.num_rows)
                held.append(batch.slice(0, stop))
            batch = batch.slice(stop)
    if held:
        yield _window_repeats(pa.concat_batches(held))


def _cut_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted cells of (doc, tie, text, wanted) rows."""
    for batch in batches:
        for block in slices(batch, 2, CHUNK):
            data, bounds = text_bytes(block.column(2))
            wanted = block.column(3)
            count = wanted.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(block.num_rows), count)
            flat = wanted.flatten()
            start, windows, anchor = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            low = bounds[row] + start
            size = windows.astype(np.int64) + LENGTH - 1
            ends = np.append(0, np.cumsum(size))
            place = np.arange(ends[-1]) + np.repeat(low - ends[:-1], size)
            body = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[place])])
            doc, tie = (block.column(k).to_numpy()[row] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), flat.field(3), pa.array(doc), pa.array(tie), pa.array(start), body.cast(pa.binary())],
                ["anchor", "hot", "doc", "tie", "start", "bytes"],
            )


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, tie and text: the tie tells rows of one document id with different texts apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # Many rows may lack an id or share one, so a long hash tells them apart.
    tie: Column = F.xxhash64(whole)
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), tie.alias("tie"), whole.alias("text"))


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, tie, start and length (in windows) of runs of windows that repeat earlier ones; runs may overlap."""
    rows = _keyed(docs, key, text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = max(parts, -(-size // BUCKET_BYTES))
    decided = _decided(rows, text_suffixes, SAMPLE_BYTES / max(size, 1), number)
    ranges = decided.filter(F.col("kind") == DUPLICATE).select("doc", "tie", "start", "length")

    opened = decided.filter(F.col("kind") == OPEN_CELL).select("anchor", "doc", "tie", "start", F.col("length").alias("windows"))
    hot = opened.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    # Written first, so that the planner knows how few there are and leaves the open cells where they are.
    hot = materialise(hot, "hot-anchors")
    marked = opened.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = marked.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "windows", "anchor", "hot")).alias("wanted"))
    schema = "anchor long, hot boolean, doc long, tie long, start long, bytes binary"
    cut = materialise(rows.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "wanted").mapInArrow(_cut_cells, schema), "cells")

    cold = cut.filter("NOT hot").drop("hot").repartitionByRange(number, "anchor").sortWithinPartitions("anchor")
    ranges = ranges.union(cold.mapInArrow(_sort_open_cells, "doc long, tie long, start long, length int"))
    hot_cells = cut.filter("hot")
    count = hot_cells.count()
    if count:
        shared = _decided(hot_cells, window_suffixes, SAMPLED / count, max(parts, -(-count * CELL // GATHERED)))
        ranges = ranges.union(shared.filter(F.col("kind") == DUPLICATE).select("doc", "tie", "start", "length"))
    return ranges


def _digest_rows(with_rest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, 1):
                data, bounds = text_bytes(block.column(1))
                ranges = block.column(2)
                count = pc.fill_null(ranges.value_lengths(), 0).to_numpy(zero_copy_only=False)
                at = np.repeat(bounds[:-1], count)
                flat = ranges.flatten()
                start, length = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, at + start, 1)
                np.add.at(depth, at + start + length + LENGTH - 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = bounds[:-1][np.diff(bounds) > 0]
                begins[heads] = gone[heads]
                rest = data[~gone]
                kept = np.append(0, np.cumsum(~gone))[bounds]
                spans = np.append(0, np.cumsum(begins))[bounds]
                bodies = [rest[a:b].tobytes() for a, b in zip(kept, kept[1:])]
                columns = [block.column(0), pa.array(np.diff(bounds)), pa.array(np.diff(bounds) - np.diff(kept)), pa.array(np.diff(spans))]
                columns.append(pa.array([hashlib.sha256(b).hexdigest() for b in bodies]))
                names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_rest:
                    columns, names = [*columns, pa.array(bodies, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_rest: bool = True) -> DataFrame:
    """Per row: the key, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_rest``, the remaining bytes as ``kept``.

    The rest is binary, since a cut may fall inside a character.
    """
    found = repeated_ranges(docs, key, text).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "length")).alias("ranges"))
    rows = _keyed(docs, key, text).withColumn("key", F.when(F.col("doc") != NULL_ID, F.col("doc")))
    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_rest else "")
    joined = rows.join(found, ["doc", "tie"], "left").select("key", "text", "ranges")
    return joined.mapInArrow(_digest_rows(with_rest), schema).withColumnRenamed("key", key)
