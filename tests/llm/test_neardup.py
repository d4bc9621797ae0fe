"""Classes against brute force over all pairs."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from saltmarsh.llm import components, neardup
from saltmarsh.llm.words import word_hashes


def brute_force(texts):
    """Class (least place) of every text by weighted Jaccard over all pairs."""
    words, bounds, _ = word_hashes(pa.array([(t or "").lower() for t in texts]))
    sets = [neardup.shingles(words[a:b]) for a, b in zip(bounds, bounds[1:])]
    table = np.zeros(1 << neardup.SLOT_BITS, np.int64)
    for s in sets:
        table[np.unique(neardup.slots(s))] += 1
    weights = neardup.inverse_frequencies(sum(len(s) > 0 for s in sets), table)
    label = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a]) and len(sets[b]) and neardup.weighted_jaccard(sets[a], sets[b], weights) >= 0.8:
            old, new = sorted((label[a], label[b]), reverse=True)
            label = [new if x == old else x for x in label]
    return label


def test_against_brute_force(spark):
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = random.choice(words, random.integers(60, 200)).tolist()
        texts.append(" ".join(base))
        for changes in (0, 1, 2, 4, 25):  # from equal over near to far
            edited = base[:]
            for i in random.integers(0, len(base), changes):
                edited[i] = str(random.choice(words))
            texts.append(" ".join(edited))
    shared = random.choice(words, 60).tolist()  # a passage that many texts share
    texts += [" ".join(shared + random.choice(words, 150).tolist()) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    wanted = brute_force(texts)
    assert [found[n] for n in range(len(texts))] == wanted
    kept = sorted(r.doc_id for r in neardup.without_near_duplicates(docs).collect())
    assert kept == sorted(set(wanted))


def test_sampling_probability_is_weighted_jaccard():
    random = np.random.default_rng(5)
    values = np.unique(random.integers(0, 1 << 62, 60).astype(np.uint64))
    left = random.uniform(0.5, 3, len(values))
    right = left * random.choice([1, 1, 0.5, 2], len(values))
    sampler = neardup.Sampler(3000)
    samples = sampler.sample(np.concatenate([values, values]), np.log(np.concatenate([left, right])).astype(np.float32), np.array([0, len(values)]))
    wanted = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    assert abs((samples[0] == samples[1]).mean() - wanted) < 0.04


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_edges(request, name):
    docs = request.getfixturevalue(name)
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    classes = {}
    for r in found:
        classes.setdefault(r.doc_id, set()).add(r.class_id)
    if name != "empty":
        assert classes[1] == {1} and classes[2] == {1}
        assert all(classes[n] == {n} for n in (3, 4, 5, 6, 7, 8))
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    if name != "empty":
        assert [i for i, _ in ids] == [0, 0, 1, 3, 4, 5, 6, 7, 8]


def test_components_of_chains_and_stars(spark):
    chain = [(n, n + 1) for n in range(100, 140)]
    star = [(7, n) for n in range(8, 60)] + [(60, 61), (61, 59)]
    links = spark.createDataFrame(chain + star + [(3, 3), (5, 4), (4, 5)], "a long, b long")
    found = {r.node: r.label for r in components.components(links, "a", "b").collect()}
    assert found == {n: 100 for n in range(100, 141)} | {n: 7 for n in range(7, 62)} | {4: 4, 5: 4}
    none = links.filter("a < 0")
    assert components.components(none, "a", "b").count() == 0


def edited_family(copies, length, edits):
    """Texts that differ from one absent original in a few words each."""
    random = np.random.default_rng(11)
    base = [f"w{i}" for i in random.integers(0, 5000, length)]
    texts = []
    for n in range(copies):
        edited = base[:]
        for i in random.choice(length, edits, replace=False):
            edited[i] = f"x{n}y{i}"
        texts.append(" ".join(edited))
    return texts


def test_family_without_its_original(spark):
    texts = edited_family(1000, 1000, 10)
    words, bounds, _ = word_hashes(pa.array(texts))
    sets = [np.unique(neardup.shingles(words[a:b])) for a, b in zip(bounds, bounds[1:])]
    table = np.zeros(1 << neardup.SLOT_BITS, np.int64)
    for s in sets:
        table[np.unique(neardup.slots(s))] += 1
    weights = neardup.inverse_frequencies(len(sets), table).astype(float)
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    every = every[counts > 1]
    held = np.stack([np.isin(every, s) for s in sets]).astype(float)
    common = (held * weights[neardup.slots(every)]) @ held.T
    total = np.array([weights[neardup.slots(s)].sum() for s in sets])
    label = np.arange(len(texts))
    pairs = np.argwhere(np.triu(common / (total[:, None] + total - common) >= 0.8, 1))
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label[label == high] = low
    assert len(pairs) > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert [found[n] for n in range(len(texts))] == label.tolist()


def test_links_of_blocks_are_those_of_all_pairs(monkeypatch):
    random = np.random.default_rng(4)
    weights = random.uniform(1, 2, 1 << neardup.SLOT_BITS).astype(np.float32)
    base = random.integers(0, 1 << 32, 40)
    for size in (1 << 21, 50):  # of the parts that are added up
        monkeypatch.setattr(neardup, "PAIRED", size)
        sets = [np.sort(np.append(random.choice(base, 40), random.integers(0, 9, 5))).astype("<u4") for _ in range(40)]
        sets += [np.sort(np.append(s[3:], s[:2])).astype("<u4") for s in sets[:20]]
        classes, side = random.integers(0, 50, len(sets)), random.integers(0, 2, len(sets))
        for side in (side, 0 * side):
            label, wanted = classes.copy(), classes.copy()
            for a, b in combinations(range(len(sets)), 2):
                if (not side.any() or side[a] != side[b]) and neardup.weighted_jaccard(sets[a], sets[b], weights) >= 0.8:
                    wanted[wanted == wanted[b]] = wanted[a]
            for a, b in neardup.block_links(sets, classes, side, weights, 0.8):
                label[label == label[b]] = label[a]
            assert (label[:, None] == label).tolist() == (wanted[:, None] == wanted).tolist()
