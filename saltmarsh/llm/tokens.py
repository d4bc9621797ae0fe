"""Token ids and token counts of whole texts.

A byte-level BPE splits a text before it merges, and never merges across such a
split. Before a single blank that is followed by a visible character there is
always a split, so the text may be cut there into units, and equal units have
equal ids. Each Python worker keeps the units it has met; only new ones go to
the tokenizers library (ids) or the merge loop (counts). A text that contains
the string of a special token stays one unit.

Null and empty texts have no ids. Repeated rows are counted each on its own.
Columns other than the key and the text are left out.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from saltmarsh.llm.worker import process_cache, slices, texts_of

# Units that a worker keeps before it drops the rare ones, by number and by characters.
KEPT_UNITS = 600_000
KEPT_CHARS = 24 << 20
# Bytes of text that are encoded at a time.
ENCODED_BYTES = 2 << 20
# New units that go to the tokenizers library as one text.
JOINED_UNITS = 2_000

# A blank before a character that no Unicode version takes for white space.
CUT = re.compile(" (?=[!-~¡-ᙿ])")
ODD = re.compile(" (?![!-~¡-ᙿ])")

# Fixed value: the split of byte-level BPE texts before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file by content, so that executors need no copy of it."""

    content: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return Vocabulary(file.read())

    @staticmethod
    def named(name: str = "byte_bpe_50k.json") -> Vocabulary:
        import public_tokenizers

        return Vocabulary.load(public_tokenizers.path(name))

    def size(self) -> int:
        parsed = json.loads(self.content)
        ids = list(parsed["model"]["vocab"].values()) + [t["id"] for t in parsed["added_tokens"]]
        return max(ids) + 1

    def splits_at_blanks(self) -> bool:
        """Whether units may be cut at blanks: a plain byte-level BPE that changes no text first."""
        parsed = json.loads(self.content)
        pre = parsed.get("pre_tokenizer") or {}
        return (
            parsed["model"]["type"] == "BPE"
            and not parsed.get("normalizer")
            and not parsed.get("post_processor")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", False)
            and not any(" " in s or t["normalized"] or t["lstrip"] or t["rstrip"] for t in parsed["added_tokens"] for s in [t["content"]])
        )

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for, in a byte-level vocabulary."""
        parsed = json.loads(self.content)
        lengths = np.zeros(self.size(), np.int64)
        for token, i in parsed["model"]["vocab"].items():
            lengths[i] = len(token)
        for token in parsed["added_tokens"]:
            lengths[token["id"]] = len(token["content"].encode())
        return lengths

    def specials(self) -> list[str]:
        return [t["content"] for t in json.loads(self.content)["added_tokens"]]


class Units(dict):
    """Unit to code. The first unit of a text stands in a tuple; others lost their blank."""

    def __init__(self, known=()) -> None:
        super().__init__(known)
        self.fresh: list = []

    def __missing__(self, unit):
        code = len(self)
        self[unit] = code
        self.fresh.append(unit)
        return code


class UnitCoder:
    """Texts to unit codes, with what a subclass learns about each unit."""

    def __init__(self, specials: Sequence[str], cuts: bool) -> None:
        self.specials, self.cuts = list(specials), cuts
        self.units, self.chars, self.uses = Units(), 0, np.zeros(0, np.int64)

    def keep(self, codes: np.ndarray) -> None:
        """Drop what was learnt about all other units."""
        raise NotImplementedError

    def learn(self, fresh: list) -> None:
        """Learn about new units, in the order of their codes."""
        raise NotImplementedError

    def drop_rare(self) -> None:
        least = 2
        while np.count_nonzero(self.uses >= least) > KEPT_UNITS // 2:
            least *= 2
        kept = np.flatnonzero(self.uses >= least)
        names = list(self.units)
        units = Units((names[i], n) for n, i in enumerate(kept))
        chars = sum(len(u) if isinstance(u, str) else len(u[0]) for u in units)
        if chars > KEPT_CHARS // 2:
            kept, units, chars = kept[:0], Units(), 0
        self.units, self.chars, self.uses = units, chars, np.zeros(len(kept), np.int64)
        self.keep(kept)

    def pieces(self, text: str) -> list[str]:
        if not self.cuts or any(s in text for s in self.specials):
            return [text]
        return text.split(" ") if ODD.search(text) is None else CUT.split(text)

    def codes(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all units, and where each text starts in them."""
        if len(self.units) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self.drop_rare()
        keys: list = []
        starts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            starts[i] = len(keys)
            parts = self.pieces(text)
            parts[0] = (parts[0],)
            keys += parts
        codes = np.fromiter(map(self.units.__getitem__, keys), np.int64, len(keys))
        fresh, self.units.fresh = self.units.fresh, []
        if fresh:
            self.learn(fresh)
            self.chars += sum(len(u) if isinstance(u, str) else len(u[0]) for u in fresh)
        self.uses = np.append(self.uses, np.zeros(len(self.units) - len(self.uses), np.int64))
        self.uses += np.bincount(codes, minlength=len(self.uses))
        return codes, starts


class Encoder(UnitCoder):
    """Ids as the tokenizers library gives them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.content)
        super().__init__(vocabulary.specials(), vocabulary.splits_at_blanks())
        self.bytes = vocabulary.byte_lengths() if self.cuts else None
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.offset, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def keep(self, codes: np.ndarray) -> None:
        self.flat = gather(self.flat, self.offset[codes], self.length[codes])
        self.used, self.length = len(self.flat), self.length[codes]
        self.offset = np.cumsum(self.length) - self.length

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths

    def learn(self, fresh: list) -> None:
        # Later units go to the library joined: they start with a blank, where it splits in any
        # case, and the bytes behind the ids tell where each unit ends.
        first = np.fromiter((isinstance(u, tuple) for u in fresh), bool, len(fresh))
        later = [" " + u for u in fresh if isinstance(u, str)]
        ids, lengths = self.ids([u[0] for u in fresh if isinstance(u, tuple)])
        more, _ = self.ids(["".join(later[i : i + JOINED_UNITS]) for i in range(0, len(later), JOINED_UNITS)])
        ends = np.searchsorted(np.cumsum(self.bytes[more]) if later else ids, np.cumsum([len(u.encode()) for u in later]), "left") + 1
        length = np.empty(len(fresh), np.int64)
        offset = np.empty(len(fresh), np.int64)
        length[first], offset[first] = lengths, np.cumsum(lengths) - lengths
        if later:
            length[~first] = np.diff(ends, prepend=0)
            offset[~first] = len(ids) + ends - length[~first]
        ids = np.append(ids, more)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.offset = np.append(self.offset, self.used + offset)
        self.length = np.append(self.length, length)
        self.used += len(ids)

    def encode(self, texts: Sequence[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text; ``end`` closes every text."""
        codes, starts = self.codes(texts)
        lengths = self.length[codes]
        ids = gather(self.flat, self.offset[codes], lengths)
        bounds = np.append(np.append(0, np.cumsum(lengths))[starts], len(ids))
        if end is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end))
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


def gather(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` one after another."""
    into = np.cumsum(lengths)
    return flat[np.repeat(offsets - (into - lengths), lengths) + np.arange(into[-1] if len(into) else 0)]


def merge_count(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left after byte-pair merging.

    A heap holds the adjacent pairs by rank, then by place; a linked list holds
    the symbols. A popped pair that no longer stands there is passed over: a rank
    names one pair, so the pair that starts at a place is known by its rank.
    The count is the initial number of symbols less the merges.
    """
    n = len(symbols)
    find = ranks.get
    pairs = list(map(find, zip(symbols, symbols[1:])))
    heap = [(pair[0], i) for i, pair in enumerate(pairs) if pair]
    if not heap:
        return n
    pairs.append(None)
    heapq.heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    left = n
    while heap:
        rank, i = heapq.heappop(heap)
        pair = pairs[i]
        if pair is None or pair[0] != rank:
            continue
        new = symbols[i] = pair[1]
        j = after[i]
        pairs[j] = None
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            pairs[i] = pair = find((new, symbols[k]))
            if pair:
                heapq.heappush(heap, (pair[0], i))
        else:
            pairs[i] = None
        h = before[i]
        if h >= 0:
            pairs[h] = pair = find((symbols[h], new))
            if pair:
                heapq.heappush(heap, (pair[0], h))
    return left


class Counter(UnitCoder):
    """Token counts by :func:`merge_count`; no ids are made."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex

        if not vocabulary.splits_at_blanks():
            raise ValueError("merging counts need a plain byte-level BPE")
        model = json.loads(vocabulary.content)["model"]
        ids = model["vocab"]
        self.split = regex.compile(PRE_TOKENS)
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left], ids[right]] = (rank, ids[left + right])
        # Bytes that are no visible Latin-1 character are written as characters from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.symbol = [ids[letters[b]] for b in range(256)]
        special = vocabulary.specials()
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.count, self.words = np.zeros(0, np.int64), {}
        super().__init__(special, True)

    def keep(self, codes: np.ndarray) -> None:
        self.count, self.words = self.count[codes], {}

    def learn(self, fresh: list) -> None:
        texts = [" " + u if isinstance(u, str) else u[0] for u in fresh]
        self.count = np.append(self.count, np.fromiter(map(self.count_unit, texts), np.int64, len(texts)))

    def count_part(self, part: str) -> int:
        total = 0
        for word in self.split.findall(part):
            known = self.words.get(word)
            if known is None:
                known = merge_count([self.symbol[b] for b in word.encode()], self.ranks)
                if len(word) <= 64:
                    self.words[word] = known
            total += known
        return total

    def count_unit(self, unit: str) -> int:
        if self.special is None:
            return self.count_part(unit)
        parts = self.special.split(unit)
        return len(parts) - 1 + sum(map(self.count_part, parts))

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        codes, starts = self.codes(texts)
        return np.add.reduceat(self.count[codes], starts) if len(texts) else np.zeros(0, np.int64)


def encoder(vocabulary: Vocabulary) -> Encoder:
    return process_cache("tokens", ("encoder", vocabulary), lambda: Encoder(vocabulary))


def count_tokens(
    docs: DataFrame, vocabulary: Vocabulary, limit: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (``n_tokens > limit``) of every row, without a shuffle."""
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = process_cache("tokens", ("counter", vocabulary), lambda: Counter(vocabulary))
        for batch in batches:
            for part in slices(batch, 2, ENCODED_BYTES):
                n = counter.counts(texts_of(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n)], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.octet_length(text).cast("long"), F.lit(0)).alias("n_bytes"), F.col(text).alias("text")
    )
    counted = rows.mapInArrow(run, schema)
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def encoded_slices(
    batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, end: int | None, text: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids of their texts and the bounds of each text."""
    code = encoder(vocabulary)
    for batch in batches:
        for part in slices(batch, text, ENCODED_BYTES):
            yield part, *code.encode(texts_of(part.column(text)), end)
