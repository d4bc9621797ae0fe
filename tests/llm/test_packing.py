"""Best fit over counts equals best fit piece by piece; every id lies in one piece."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from saltmarsh.llm import packing, tokens

VOCABULARY = tokens.Vocabulary.named()


def best_fit(lengths, window):
    """How many windows hold which multiset of lengths, one piece at a time."""
    windows = []
    for length in sorted(lengths, reverse=True):
        fitting = [w for w in windows if window - sum(w) >= length]
        if fitting:
            min(fitting, key=lambda w: window - sum(w)).append(length)
        else:
            windows.append([length])
    return Counter(window - sum(w) for w in windows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan_equals_best_fit(lengths):
    runs = packing.plan_runs(Counter(lengths), 32)
    placed = defaultdict(list)
    for length, count in Counter(lengths).items():
        own = sorted((tuple(r) for r in runs.tolist() if r[0] == length), key=lambda r: r[1])
        for rank in range(count):
            _, first, sequence, offset, each = [r for r in own if r[1] <= rank][-1]
            placed[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 32
    assert sorted(placed) == list(range(len(placed)))
    assert Counter(32 - sum(n for _, n in p) for p in placed.values()) == best_fit(lengths, 32)


def test_capacity_tree():
    tree = packing.CapacityTree(2048)
    assert tree.tightest(1) is None
    for room in (5, 700, 2048):
        tree.set(room, True)
    assert [tree.tightest(n) for n in (1, 5, 6, 700, 701, 2048)] == [5, 5, 700, 700, 2048, 2048]
    tree.set(2048, False)
    assert tree.tightest(701) is None


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_pack(request, name):
    docs = request.getfixturevalue(name)
    library = Tokenizer.from_str(VOCABULARY.content)
    found = packing.pack(docs, VOCABULARY, window=64, end=1, keep_ids=True).collect()
    wanted = Counter(tuple(library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect())
    # Repeated rows have equal pieces; each start occurs as often as the document.
    assert sum(r.length for r in found) == sum(len(ids) * n for ids, n in wanted.items())
    windows = defaultdict(list)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    whole = defaultdict(dict)
    for r in found:
        if r.doc_id not in (None, 1):
            whole[r.doc_id][r.start] = r.ids
    for r in docs.filter("doc_id not in (1)").collect():
        if r.doc_id is not None:
            ids = [i for start in sorted(whole[r.doc_id]) for i in whole[r.doc_id][start]]
            assert ids == library.encode(r.text or "", add_special_tokens=False).ids + [1]


def test_little_padding(spark, small):
    found = packing.pack(spark.read.parquet(f"{small}/documents.parquet"), VOCABULARY).toPandas()
    used = found.groupby("sequence_id")["length"].sum()
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.97
