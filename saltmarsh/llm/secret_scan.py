"""Secret scan through a trigram inverted index.

From each rule's regex a Boolean query over trigrams follows: a list of clauses
that must all hold, each a choice of literal strings, each string the trigrams
it consists of. Texts come in blocks; of every block the postings of the
trigrams that any rule needs are taken in one pass over its bytes (ASCII folded
to lower case), the postings of a query are intersected and united, and only
the candidate texts are matched with the regex. A rule without mandatory
trigrams, such as long hexadecimal runs, is matched on every text.

The index of a block is made, used and dropped inside a task: at no size does it
meet another machine, and the scan has no shuffle.

Null and empty texts hold no secret. Repeated rows are scanned each. Other
columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from re import _constants as C, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from saltmarsh.llm.worker import process_cache, slices, texts_of

# Strings that one part of a pattern may stand for before it counts as anything.
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    # Length that a group of the match must have, else the match is dropped.
    group: int = 0
    least: int = 0
    base: bool = field(default=True)


# The kinds that every scan reports.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of any length that is then too short drops out either way
)
# Further kinds; they only add spans.
EXTRA_RULES = (
    # Up to its END line if no other key begins before; else over the lines of base64 that follow.
    # Line ends may be escaped or have become blanks. Repeats are possessive, so no text is slow.
    Rule(
        "private_key",
        r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----"
        r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
        r"|(?:(?:[^\S\r\n]*+(?:\r?\n|\\r|\\n))++(?:Proc-Type|DEK-Info):(?:(?!\\[rn])[^\r\n])*+)*+"
        r"(?:(?:[^\S\r\n]*+(?:\r?\n|\\r|\\n))++[^\S\r\n]*+[A-Za-z0-9+/=]++(?=[^\S\r\n]*+(?:[\r\n]|\\[rn]|\Z))"
        r"|[^\S\r\n]*+[A-Za-z0-9+/=]{40,}+)*+)",
        base=False,
    ),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)
RULES = BASE_RULES + EXTRA_RULES

# A clause is a set of alternatives, each a set of trigrams; every clause must hold.
Query = list[frozenset[frozenset[bytes]]]


def trigram_query(pattern: str) -> Query:
    """Clauses that every match of the pattern satisfies; none if nothing is mandatory."""
    clauses: Query = []
    run = _walk(_parser.parse(pattern), {""}, clauses)
    _flush(run, clauses)
    return clauses


def _flush(strings: set[str] | None, clauses: Query) -> None:
    """A choice of strings in a row becomes a clause, unless one of them has no trigram."""
    if strings and all(len(s.encode()) >= 3 for s in strings):
        clauses.append(frozenset(frozenset(s.encode()[i : i + 3] for i in range(len(s.encode()) - 2)) for s in strings))


def _walk(items, run: set[str], clauses: Query) -> set[str]:
    """Strings that can end just here; clauses take those that ended before."""
    for op, value in items:
        strings = _strings(op, value)
        if strings is None or len(run) * len(strings) > MOST_STRINGS:
            _flush(run, clauses)
            run = {""}
            _inside(op, value, clauses)
            if strings is not None and len(strings) <= MOST_STRINGS:
                run = strings
        else:
            run = {a + b for a in run for b in strings}
    return run


def _inside(op, value, clauses: Query) -> None:
    """Clauses from a part that must occur but stands for too many strings."""
    if op is C.SUBPATTERN:
        _flush(_walk(value[3], {""}, clauses), clauses)
    elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
        _flush(_walk(value[2], {""}, clauses), clauses)


def _strings(op, value) -> set[str] | None:
    """All strings that a part of a pattern stands for, in lower case; None if too many."""
    if op is C.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if op is C.IN:
        found: set[str] = set()
        for kind, part in value:
            if kind is C.LITERAL and part < 128:
                found.add(chr(part).lower())
            elif kind is C.RANGE and part[1] < 128:
                found |= {chr(c).lower() for c in range(part[0], part[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.BRANCH:
        found = set()
        for branch in value[1]:
            strings = _sequence(branch)
            if strings is None:
                return None
            found |= strings
        return found
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[1] <= 4:
        once = _sequence(value[2])
        if once is None:
            return None
        found, power = set(), {""}
        for count in range(value[1] + 1):
            if count >= value[0]:
                found |= power
            power = {a + b for a in power for b in once}
            if len(found) + len(power) > MOST_STRINGS:
                return None
        return found
    return None


def _sequence(items) -> set[str] | None:
    found = {""}
    for op, value in items:
        strings = _strings(op, value)
        if strings is None or len(found) * len(strings) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in strings}
    return found


class BlockIndex:
    """Postings of the needed trigrams, one block of texts at a time."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = [(rule, re.compile(rule.pattern), trigram_query(rule.pattern)) for rule in rules]
        needed = sorted({t for _, _, query in self.rules for clause in query for choice in clause for t in choice})
        self.needed = needed
        self.number = {t: n for n, t in enumerate(needed)}
        self.lower = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
        self.codes = np.array([t[0] << 16 | t[1] << 8 | t[2] for t in needed], np.int32)
        # One bit for every trigram.
        self.bits = np.zeros(1 << 21, np.uint8)
        np.bitwise_or.at(self.bits, self.codes >> 3, np.uint8(1) << (self.codes & 7).astype(np.uint8))

    def postings(self, column: pa.Array) -> list[np.ndarray]:
        """For every needed trigram the rows of the block that hold it, ascending."""
        size = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        if data is None or offsets[-1] - offsets[0] < 3:
            return [np.zeros(0, np.int64)] * len(self.needed)
        low = self.lower[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]].astype(np.int32)
        offsets = offsets - offsets[0]
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        places = np.flatnonzero(self.bits[codes >> 3] >> (codes & 7) & 1)
        rows = np.searchsorted(offsets, places, "right") - 1
        inside = places + 3 <= offsets[rows + 1]
        pairs = np.unique(np.searchsorted(self.codes, codes[places[inside]]) * len(column) + rows[inside])
        cuts = np.searchsorted(pairs, np.arange(len(self.needed) + 1) * len(column))
        return [pairs[a:b] % len(column) for a, b in zip(cuts, cuts[1:])]

    def candidates(self, query: Query, postings: list[np.ndarray], rows: int) -> np.ndarray:
        found = None
        for clause in query:
            either = np.zeros(0, np.int64)
            for choice in clause:
                both = None
                for trigram in choice:
                    rows_with = postings[self.number[trigram]]
                    both = rows_with if both is None else np.intersect1d(both, rows_with, assume_unique=True)
                either = np.union1d(either, both)
            found = either if found is None else np.intersect1d(found, either, assume_unique=True)
        return np.arange(rows) if found is None else found

    def spans(self, column: pa.Array) -> tuple[list[int], list[int], list[int], list[int]]:
        """(row, rule, start, end) of all matches, sorted; code points, end exclusive."""
        postings = self.postings(column)
        texts: dict[int, str] = {}
        found = []
        every = None
        for n, (rule, regex, query) in enumerate(self.rules):
            for row in self.candidates(query, postings, len(column)).tolist():
                if query:
                    text = texts.get(row)
                    if text is None:
                        text = texts[row] = column[row].as_py() or ""
                else:
                    every = every or texts_of(column)
                    text = every[row]
                for m in regex.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.append((row, m.start(), n, m.end()))
        found.sort()
        return tuple([f[i] for f in found] for i in (0, 2, 1, 3))


def _index(rules: tuple[Rule, ...]) -> BlockIndex:
    return process_cache("secrets", rules, lambda: BlockIndex(rules))


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (kind, start, end), by start and then in the order of the rules."""
    rules = tuple(rules)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("spans", SPANS)])
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(rules)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                row, rule, start, end = index.spans(part.column(1))
                offsets = np.searchsorted(np.array(row, np.int64), np.arange(part.num_rows + 1))
                values = pa.StructArray.from_arrays(
                    [pa.array([kinds[r] for r in rule], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    ["kind", "start", "end"],
                )
                spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), spans], ["key", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, key: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text."""
    base = [r.kind for r in rules if r.base]

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(kind).alias(f"n_{kind}") for kind in base]
    kept = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(key, *counts, F.sha2(joined(kept), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The same rows and columns with every secret replaced by ``[kind]``; null stays null.

    Overlapping spans are replaced as one, under the kind that starts first.
    """
    rules = tuple(rules)
    place = docs.columns.index(text)
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(rules)
        for batch in batches:
            for part in slices(batch, place, 1 << 20):
                column = part.column(place)
                rows, rule, start, end = index.spans(column)
                if rows:
                    texts = column.to_pylist()
                    n = 0
                    while n < len(rows):
                        row, old, at, out = rows[n], texts[rows[n]], 0, []
                        while n < len(rows) and rows[n] == row:
                            if start[n] >= at:
                                out += [old[at : start[n]], f"[{kinds[rule[n]]}]"]
                            at = max(at, end[n])
                            n += 1
                        texts[row] = "".join(out) + old[at:]
                    column = pa.array(texts, column.type)
                arrays = [column if i == place else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(arrays, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
