"""Spelling variants: words that differ by one letter, grouped below the form that is far more frequent.

Words are counted in the tasks before anything is shuffled, so a frequent word is
one row per task. Two words are *near* if one inserted, deleted or replaced code
point turns one into the other. For each length that the shorter one of two near
words can have, a word is cut into thirds. An edit falls into one of them, so two
near words share the letters of the other two: every word is put on one sorted list
for each pair of thirds, which holds what is left of it. A pair of near words is
taken from one list only.

A list is scanned by each of its words with the banded rows of the edit matrix, three
cells for each leading part of a listed rest. The next listed one reuses the rows
of the part it shares with the one before; where all cells of a row exceed one
edit, the scan jumps over all that have that leading part. A list longer than
``LIST`` is cut into ranges, and a word is sent only to the ranges whose shared
leading part its own rows allow.

Words that nothing else is near have no form and are their own root. Chains of
forms end after a few steps, since each form is several times as frequent. Null
texts have no words; a null document id is written as nothing. Columns other than
the id and the text are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from saltmarsh.llm.words import CHUNK, Powers, mix, text_bytes
from saltmarsh.llm.worker import process_cache, slices
from saltmarsh.operators.rows import materialise, number_rows

SHORTEST = 6
LEAST = 5
RATIO = 5
# Words of one range of a sorted list.
LIST = 2048
# Distinct words that a task holds before it passes them on.
HELD = 200_000
# Longer runs of letters are hashed one by one.
LONG_RUN = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def letter_runs(data: np.ndarray, bounds: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and code points of the runs of at least so many letters A-Z, a-z and U+00C0 to U+00FF.

    The last ones are two bytes each, of which the first is C3 and no other letter has it.
    """
    lead = data == 0xC3
    low = data | 0x20
    letter = lead | ((low >= 97) & (low <= 122) & (data < 128))
    letter[1:] |= lead[:-1]
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = letter[edges]
    ends[edges - 1] = letter[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    leads = np.append(0, np.cumsum(lead))
    points = stop - start - (leads[stop] - leads[start])
    kept = points >= shortest
    return start[kept], stop[kept], points[kept]


def run_checksums(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seeds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of a seed's text followed by each run; ``seeds`` are the checksums of those texts."""
    order = np.argsort(start - stop, kind="stable")
    begin, size = start[order], (stop - start)[order]
    state = ~seeds[order].astype(np.uint32)
    long = int((size > LONG_RUN).sum())
    for step in range(int(size[long]) if long < len(size) else 0):
        active = slice(long, int(np.searchsorted(-size, -step, "left")))
        state[active] = table[(state[active] ^ data[begin[active] + step]) & 255] ^ (state[active] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for k in order[:long]:
        out[k] = zlib.crc32(data[start[k] : stop[k]].tobytes(), int(seeds[k]))
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, damaged: int | None = None) -> DataFrame:
    """word, n of all runs of letters with at least ``shortest`` code points, A-Z in lower case.

    ``damaged`` deletes a letter from the runs of which it divides the checksum.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _crc_table()
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for block in slices(batch, 1, CHUNK):
                data, bounds = text_bytes(block.column(1))
                data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
                start, stop, points = letter_runs(data, bounds, shortest)
                if damaged:
                    seeds = np.array([zlib.crc32(b"%s:" % ("" if d is None else str(d)).encode()) for d in block.column(0).to_pylist()], np.uint32)
                    row = np.searchsorted(bounds, start, "right") - 1
                    sums = run_checksums(data, start, stop, seeds[row], table)
                    hit = sums % damaged == 0
                    for k in np.flatnonzero(hit & (points > shortest)):
                        word = data[start[k] : stop[k]].tobytes().decode()
                        at = int(sums[k]) % len(word)
                        word = (word[:at] + word[at + 1 :]).encode()
                        held[word] = held.get(word, 0) + 1
                    start, stop = start[~hit], stop[~hit]
                for one, number in _distinct_runs(data, start, stop):
                    held[one] = held.get(one, 0) + number
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col(key), F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _distinct_runs(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """Distinct runs and how often each occurs, told apart by a hash of their bytes."""
    if not len(start):
        return
    powers = process_cache("hashes", "powers", Powers)
    # A single text longer than a block is hashed in steps, as the powers reach no further.
    low = 0
    while low < len(start):
        base = start[low]
        high = max(low + 1, int(np.searchsorted(stop, base + CHUNK, "right")))
        part = data[base : stop[high - 1]]
        with np.errstate(over="ignore"):
            powers.to(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(powers.byte[part] * powers.up[: len(part)], out=sums[1:])
            a, b = start[low:high] - base, stop[low:high] - base
            hashes = mix((sums[b] - sums[a]) * powers.down[a] + (b - a).astype(np.uint64))
        _, first, numbers = np.unique(hashes, return_index=True, return_counts=True)
        for k, number in zip(first.tolist(), numbers.tolist()):
            yield part[a[k] : b[k]].tobytes(), number
        low = high


Row = tuple[int, int, int]
DEAD = 2


def next_row(row: Row, depth: int, letter: str, query: str) -> Row:
    """Row of the edit matrix after one more letter of a listed word, cells depth - 1, depth and depth + 1; two means more than one."""
    before, same, after = row
    size = len(query)
    left = min(before + (depth < 2 or letter != query[depth - 2]), same + 1, DEAD) if 0 < depth <= size + 1 else DEAD
    middle = min(same + (letter != query[depth - 1]), after + 1, left + 1, DEAD) if depth <= size else DEAD
    right = min(after + (letter != query[depth]), middle + 1, DEAD) if depth < size else DEAD
    return left, middle, right


def first_row(query: str) -> Row:
    return DEAD, 0, 1 if query else DEAD


class SortedList:
    """Words in code-point order, with the length of the part each shares with the one before it."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.shared = [0] * len(words)
        for k in range(1, len(words)):
            one, other = words[k - 1], words[k]
            size = min(len(one), len(other))
            at = 0
            while at < size and one[at] == other[at]:
                at += 1
            self.shared[k] = at
        # The next word that shares less with its neighbour.
        self.less = [len(words)] * len(words)
        open_: list[int] = []
        for k, at in enumerate(self.shared):
            while open_ and self.shared[open_[-1]] > at:
                self.less[open_.pop()] = k
            open_.append(k)

    def near(self, query: str) -> list[int]:
        """Places of all words at exactly one edit from the query."""
        found = []
        rows = [first_row(query)]
        words, shared, count = self.words, self.shared, len(self.words)
        size = len(query)
        k = 0
        while k < count:
            word = words[k]
            del rows[shared[k] + 1 :]
            row = rows[-1]
            for depth in range(len(rows), len(word) + 1):
                row = next_row(row, depth, word[depth - 1], query)
                rows.append(row)
                if min(row) >= DEAD:
                    break
            if min(row) >= DEAD:
                dead = len(rows) - 1
                k += 1
                while k < count and shared[k] >= dead:
                    k = self.less[k]
                continue
            if abs(size - len(word)) <= 1 and row[size - len(word) + 1] == 1:
                found.append(k)
            k += 1
        return found


def may_hold(query: str, least: str, most: str) -> bool:
    """Whether a sorted range with these ends can hold a word within one edit."""
    row = first_row(query)
    for depth, (letter, other) in enumerate(zip(least, most), 1):
        if letter != other:
            break
        row = next_row(row, depth, letter, query)
        if min(row) >= DEAD:
            return False
    return True


FRONT, BACK, MIDDLE = "f", "b", "m"
ROW = "list string, part long, role int, rest string, word string, n long"
ROW_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64())


def _batch(rows: list[tuple], types: tuple, names: str) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [n.split()[0] for n in names.split(", ")])


FOUND = "word string, near long, form_n long, form string"
FOUND_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string())


class _List:
    """One sorted list: rests of words, with the words and how often they occur."""

    def __init__(self, name: str, rows: list[tuple[str, str, int]]) -> None:
        self.side, shorter, _ = name.split(" ", 2)
        self.shorter = int(shorter)
        self.third = self.shorter // 3
        self.rows = sorted(rows)
        self.rests = SortedList([r[0] for r in self.rows])

    def taken_elsewhere(self, one: str, other: str) -> bool:
        """Whether a pair of this list is also one of a list that comes before it."""
        size = self.shorter - self.third
        if self.side == FRONT:
            return False
        return one[:size] == other[:size] or (self.side == MIDDLE and one[len(one) - size :] == other[len(other) - size :])

    def answer(self, rest: str, word: str) -> tuple | None:
        near = []
        for k in self.rests.near(rest):
            _, other, n = self.rows[k]
            if min(len(word), len(other)) == self.shorter and not self.taken_elsewhere(word, other):
                near.append((-n, other))
        if near:
            most, form = min(near)
            return word, len(near), -most, form
        return None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of list, range and role: how many words are near each asking word, and the most frequent of them.

    Role 0 is listed only, 1 is listed and asks, 2 asks only; what is listed comes first.
    """
    name = None
    listed: list[tuple[str, str, int]] = []
    asking: list[tuple[str, str]] = []
    table: _List | None = None
    out: list[tuple] = []

    def answer() -> None:
        nonlocal table
        if table is None:
            table = _List(name[0], listed)
        out.extend(found for rest, word in asking if (found := table.answer(rest, word)))
        asking.clear()

    for batch in batches:
        for list_, part, role, rest, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (list_, part) != name:
                if asking and (len(listed) > 1 or len(asking) > 1 or asking[0][1] != listed[0][1]):
                    answer()
                name, table = (list_, part), None
                listed, asking = [], []
            if role < 2:
                listed.append((rest, word, n))
            if role > 0:
                asking.append((rest, word))
                if role == 2 and len(asking) >= LIST:
                    answer()
        yield _batch(out, FOUND_TYPES, FOUND)
        out.clear()
    if asking:
        answer()
    yield _batch(out, FOUND_TYPES, FOUND)


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of long lists, once for every range that can hold a near word."""
    for batch in batches:
        out = []
        for list_, rest, word, n, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            out += [(list_, r["part"], 2, rest, word, n) for r in ranges if may_hold(rest, r["least"], r["most"])]
        yield _batch(out, ROW_TYPES, ROW)


def _lists(size: Column, shorter: Column) -> list[Column]:
    """The three lists of a word for one length of the shorter word, each named by the letters shared there."""
    third = F.floor(shorter / 3).cast("int")
    most = shorter - third
    parts = (
        (FRONT, F.substring("word", F.lit(1), most), F.substring("word", most + 1, size)),
        (BACK, F.substring("word", size - most + 1, most), F.substring("word", F.lit(1), size - most)),
        (
            MIDDLE,
            F.concat(F.substring("word", F.lit(1), third), F.substring("word", size - third + 1, third)),
            F.substring("word", third + 1, size - 2 * third),
        ),
    )
    named = [F.struct(F.concat_ws(" ", F.lit(side), shorter.cast("string"), shared).alias("list"), rest.alias("rest")) for side, shared, rest in parts]
    return [F.when(shorter >= 0, one) for one in named]


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n and near_word (the most frequent near word, the least of equals) of words that have near ones."""
    size = F.char_length("word")
    lists = F.array_compact(F.array(*_lists(size, size), *_lists(size, size - 1)))
    entries = materialise(words.select(F.inline(lists), "word", "n"), "lists")
    long = entries.groupBy("list").count().filter(F.col("count") > LIST).select("list")
    long = materialise(long, "long-lists")
    asked = entries.join(long, "list", "left_anti").select("list", F.lit(0).cast("long").alias("part"), F.lit(1).alias("role"), "rest", "word", "n")
    if not long.isEmpty():
        numbered = materialise(number_rows(entries.join(long, "list"), ["list", "rest", "word"], "place"), "places")
        least = numbered.groupBy("list").agg(F.min("place").alias("least_place"))
        parted = numbered.join(least, "list").withColumn("part", F.floor((F.col("place") - F.col("least_place")) / LIST))
        ends = parted.groupBy("list", "part").agg(F.min("rest").alias("least"), F.max("rest").alias("most"))
        ranges = ends.groupBy("list").agg(F.collect_list(F.struct("part", "least", "most")).alias("ranges"))
        sent = numbered.join(ranges, "list").select("list", "rest", "word", "n", "ranges").mapInArrow(_send, ROW)
        asked = asked.union(parted.select("list", "part", F.lit(0).alias("role"), "rest", "word", "n")).union(sent)
    dealt = asked.repartition("list", "part").sortWithinPartitions("list", "part", "role")
    found = dealt.mapInArrow(_scan, FOUND)
    # Of the most frequent near words the least.
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", (-F.col("_best.less")).alias("near_n"), F.col("_best.form").alias("near_word")
    )


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct (word, n) rows.

    The form is the most frequent near word if it is ``ratio`` times as frequent; the root is where forms lead.
    """
    words = materialise(words.select("word", "n"), "words")
    near = near_words(words)
    isform = F.col("near_n") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(isform, F.col("near_word")).alias("form"), F.when(isform, F.col("near_n")).alias("form_n"),
    )
    formed = materialise(formed, "forms")
    least, most = words.agg(F.min("n"), F.max("n")).first()
    steps = math.log(max(most or 1, 1) / max(least or 1, 1), ratio) + 1
    roots = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        # Every round doubles the steps that a root is ahead.
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        roots = materialise(roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "roots")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, least: int = LEAST, **options) -> DataFrame:
    return word_counts(docs, **options).filter(F.col("n") >= least)
