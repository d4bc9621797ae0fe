"""Spelling variants against plain loops over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from conftest import rows
from saltmarsh.llm import variants


def edits(one, other):
    """Whether one inserted, deleted or replaced letter makes one word the other."""
    if len(one) > len(other):
        one, other = other, one
    if len(other) - len(one) > 1 or one == other:
        return False
    at = next((i for i, (a, b) in enumerate(zip(one, other)) if a != b), len(one))
    return one[at + (len(one) == len(other)) :] == other[at + 1 :]


def counted(documents, damaged=None):
    words = Counter()
    for doc, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damaged and h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += len(run) >= 6
    return {w: n for w, n in words.items() if n}


def grouped(words, ratio=5):
    form = {}
    for w, n in words.items():
        near = [(-words[o], o) for o in words if edits(w, o)]
        best = min(near, default=(0, None))
        fits = near and -best[0] >= ratio * n
        form[w] = (best[1] if fits else None, n, len(near), -best[0] if fits else None)
    out = set()
    for w, (f, n, near, form_n) in form.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.add((w, f, root, n, near, form_n))
    return out


def made_words(seed, number):
    draw = random.Random(seed)
    bases = ["".join(draw.choices("abcéß", k=draw.randint(6, 9))) for _ in range(number)]
    words = {}
    for base in bases:
        n = draw.randint(1, 2000)
        for _ in range(draw.randint(1, 6)):
            words.setdefault(base, n)
            at, letter = draw.randrange(len(base)), draw.choice("abcdé")
            base = draw.choice([base[:at] + base[at + 1 :], base[:at] + letter + base[at:], base[:at] + letter + base[at + 1 :]])
            n = max(1, n // draw.choice([1, 6, 20]))
    return {w: n for w, n in words.items() if len(w) >= 6}


@pytest.mark.parametrize("longest", [2048, 7])
def test_equals_all_pairs(spark, monkeypatch, longest):
    """With lists cut into ranges of seven words, too."""
    monkeypatch.setattr(variants, "LIST", longest)
    words = made_words(5, 150)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert set(map(tuple, variants.group_variants(frame).collect())) == grouped(words)


def test_short_words(spark):
    words = {w: n for n, w in enumerate(["a", "b", "ab", "ba", "abc", "", "ac", "é"], 1)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert set(map(tuple, variants.group_variants(frame).collect())) == grouped(words)


def documents():
    draw = random.Random(3)
    pool = ["Straße", "naïvety", "wonderful", "WONDERFUL", "Élan-vital", "x" * 90, "y" * 70 + "é", "mountain2mountain", "ÿÿÿÿÿÿ", "short"]
    made = [(i, " ".join(draw.choices(pool, k=40))) for i in range(60)]
    return made + [(r[0], r[1]) for r in rows()]


@pytest.mark.parametrize("damaged", [None, 3, 199])
def test_counts(spark, damaged):
    frame = spark.createDataFrame(documents(), "doc_id long, text string")
    found = variants.word_counts(frame, damaged=damaged).collect()
    assert {r.word: r.n for r in found} == counted(documents(), damaged) and len(found) == len(counted(documents(), damaged))


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(variants, "CHUNK", 64)
    monkeypatch.setattr(variants, "HELD", 3)
    frame = spark.createDataFrame(documents(), "doc_id long, text string")
    assert {r.word: r.n for r in variants.word_counts(frame, damaged=3).collect()} == counted(documents(), 3)


def test_odd_documents(clashing, empty):
    assert variants.group_variants(variants.vocabulary(empty)).collect() == []
    found = variants.group_variants(variants.vocabulary(clashing))
    words = {w: n for w, n in counted([(r[0], r[1]) for r in rows()]).items() if n >= 5}
    assert set(map(tuple, found.collect())) == grouped(words)
