"""Removal of repeated byte strings against a scan of all windows."""

import hashlib
import random

import numpy as np
import pytest

from conftest import DOCUMENTS, rows
from saltmarsh.llm import suffixes
from saltmarsh.llm.suffixes import LENGTH


def by_hand(documents):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of every (doc_id, text)."""
    least = {}
    place = lambda d, at: ((d is not None, d or 0), at)
    for doc, text in documents:
        raw = (text or "").encode()
        for at in range(len(raw) - LENGTH + 1):
            key = raw[at : at + LENGTH]
            least[key] = min(least.get(key, place(doc, at)), place(doc, at))
    found = []
    for doc, text in documents:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - LENGTH + 1):
            if least[raw[at : at + LENGTH]] < place(doc, at):
                gone[at : at + LENGTH] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(raw) else 0
        found.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def digests(spark, documents):
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    found = suffixes.remove_repeats(frame)
    for row in found.select("n_bytes", "n_removed", "kept_sha256", "kept").collect():
        assert len(row.kept) == row.n_bytes - row.n_removed and hashlib.sha256(row.kept).hexdigest() == row.kept_sha256
    return sorted(map(tuple, found.drop("kept").collect()), key=str)


def passages(seed):
    """Texts made of shared passages, cut at random places, with copies, periods and accents."""
    draw = random.Random(seed)
    words = ["sun", "river", "éclair", "a", "and", "mountain", "größe", "of", "stone"]
    pool = [" ".join(draw.choices(words, k=draw.randint(10, 80))) for _ in range(12)] + ["ab" * 150, "x" * 400]
    documents = []
    for doc in range(120):
        parts = []
        for _ in range(draw.randint(0, 5)):
            passage = draw.choice(pool)
            low = draw.randint(0, len(passage) // 2)
            parts.append(passage[low : draw.randint(low, len(passage))] + " ".join(draw.choices(words, k=draw.randint(0, 20))))
        documents.append((doc, "".join(parts)))
    return documents + [(doc + 200, text) for doc, text in documents[:20]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_scan_of_all_windows(spark, seed):
    documents = passages(seed)
    assert digests(spark, documents) == by_hand(documents)


def test_anchors_with_many_open_cells(spark, monkeypatch):
    """All open cells take the way of the hot ones."""
    monkeypatch.setattr(suffixes, "HOT", 1)
    documents = passages(3)
    assert digests(spark, documents) == by_hand(documents)


def test_cut_texts(spark, monkeypatch):
    """Texts longer than a block, and tasks that deal in many small steps."""
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    monkeypatch.setattr(suffixes, "GATHERED", 10)
    documents = passages(4) + [(500, "".join(t for _, t in passages(4)[:30]))]
    assert digests(spark, documents) == by_hand(documents)


def test_odd_documents(spark, odd, clashing, empty):
    """Nulls, repeated rows, several texts of one id; other columns are left out."""
    documents = [(r[0], r[1]) for r in rows()] + [(7, "other text " * 30), (7, "yet other text " * 30), (None, "other text " * 30)]
    assert digests(spark, documents) == by_hand(documents)
    for frame in (odd, clashing):
        found = suffixes.remove_repeats(frame, with_rest=False)
        assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        assert sorted(map(tuple, found.collect()), key=str) == by_hand([(r[0], r[1]) for r in rows()])
    assert suffixes.remove_repeats(empty).collect() == []
    assert empty.schema == DOCUMENTS


def test_repeats_inside_one_cell(spark):
    """Runs and short periods that occur nowhere else, so that their cells have one content only."""
    tail = " ".join(f"w{i}" for i in range(60))
    texts = ["-" * 110, tail + "=" * 163, "+" * 227 + tail[::-1], "ab" * 60, "xyz" * 43 + "q", "#" * 100, "0123456789" * 12, ("abcdefg " * 5 + "-" * 9) * 3]
    documents = list(enumerate(texts))
    assert any(row[2] for row in by_hand(documents))
    assert digests(spark, documents) == by_hand(documents)


def test_texts_of_one_id_with_a_shared_start(spark):
    """Each row of an id is judged against earlier documents, though neither row is the earlier of the two."""
    draw = random.Random(5)
    word = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    shared = word(400)
    documents = [(1, word(150) + shared[37:222] + word(90)), (1, word(30) + shared[180:333])]
    documents += [(5, shared + word(n)) for n in (0, 40, 200, 200)] + [(None, shared[60:350]), (None, shared[60:350] + "end")]
    assert digests(spark, documents) == by_hand(documents)


def test_multikey_order():
    draw = np.random.default_rng(1)
    columns = [draw.integers(0, 3, 50_000).astype(np.uint64) for _ in range(6)] + [draw.integers(-9, 9, 50_000)]
    order = suffixes.multikey_order(50_000, [lambda at, c=c: c[at] for c in columns])
    expected = np.lexsort(columns[::-1])
    assert all((c[order] == c[expected]).all() for c in columns) and (np.sort(order) == np.arange(50_000)).all()


def test_buckets():
    draw = np.random.default_rng(2)
    keys = [draw.integers(0, 4, 300) for _ in range(3)]
    splitters = sorted(zip(*[draw.integers(0, 4, 40) for _ in range(3)]))
    expected = [sum(s < k for s in splitters) for k in zip(*keys)]
    assert suffixes.buckets(keys, [np.array(c) for c in zip(*splitters)]).tolist() == expected
