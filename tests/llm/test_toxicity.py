"""Held-out accuracy, and the edges."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from saltmarsh.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).toPandas()
    said, true = scored.score >= 0.5, scored.toxic == 1
    assert len(scored) > 500 and scored.score.between(0, 1).all()
    assert (said & true).sum() / true.sum() > 0.85
    assert (said & ~true).sum() / (~true).sum() < 0.01


def test_pairs_count_where_weights_do_not():
    """Either term alone is harmless, both together are not."""
    random = np.random.default_rng(1)
    a, b = random.integers(0, 2, (2, 600))
    labels = (a & b).astype(float)
    pairs = [(n, term) for n in range(600) for present, term in ((a[n], 11), (b[n], 22), (1, 33)) if present]
    model = toxicity.fit_arrays(*(np.array(c) for c in zip(*pairs)), labels)
    rows, slots = zip((0, 11), (1, 22), (2, 11), (2, 22), (0, 33), (1, 33), (2, 33))
    found = model.scores(np.array(rows), np.array(slots), 3)
    assert found[0] < 0.2 and found[1] < 0.2 and found[2] > 0.8


@pytest.mark.parametrize("seed", [1, 2])
def test_rare_pair_whose_terms_are_not_tied_to_the_label(seed):
    """30 of 8,000 rows hold both terms; each term alone is as toxic as the rest, among 300 common words."""
    random = np.random.default_rng(seed)
    labels = (random.random(8000) < 0.1).astype(float)
    order = random.permutation(8000)
    labels[order[:30]] = 1
    held = [np.nonzero(random.random((8000, 300)) < 0.2)]
    held += [(order[:500], np.full(500, 777)), (np.append(order[:30], order[500:970]), np.full(500, 888))]
    model = toxicity.fit_arrays(*(np.concatenate(c) for c in zip(*held)), labels)
    common = np.nonzero(random.random((200, 300)) < 0.2)

    def scores(*terms):
        parts = [common, *[(np.arange(200), np.full(200, t)) for t in terms]]
        return model.scores(*(np.concatenate(c) for c in zip(*parts)), 200)

    assert scores(777, 888).min() > 0.7
    assert max(scores(777).max(), scores(888).max(), scores().max()) < 0.3


def test_score_is_the_sum_over_pairs():
    random = np.random.default_rng(4)
    model = toxicity.constant(-1.5)
    model.weights[:50], model.factors[:50] = random.normal(size=50), random.normal(0, 0.3, (50, toxicity.FACTORS))
    texts = [sorted(random.choice(60, size, replace=False)) for size in (0, 1, 2, 9, 40)]
    rows = np.repeat(np.arange(5), [len(t) for t in texts])
    found = model.scores(rows, np.concatenate(texts).astype(int), 5)
    for score, terms in zip(found, texts):
        plain = model.bias + sum(model.weights[t] for t in terms)
        plain += sum(model.factors[a] @ model.factors[b] for i, a in enumerate(terms) for b in terms[:i])
        assert score == pytest.approx(1 / (1 + np.exp(-plain)), rel=1e-5)


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_edges(request, spark, name):
    docs = request.getfixturevalue(name)
    for labels in ([], [(1, None, None), (None, 1, 1)], [(1, 0, 0)], [(n, 0, n % 2) for n in range(9)] * 2):
        model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
        scores = [r.score for r in toxicity.score(docs, model).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
        kept = toxicity.without_toxic(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in scores)


def test_labels_of_the_held_out_fold_teach_nothing(spark, odd):
    import zlib

    held = [n for n in range(200) if zlib.crc32(str(n).encode()) % 5 == 0]
    docs = spark.createDataFrame([(n, "bad words") for n in held], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(n, 0, 1) for n in held], LABELS))
    assert not model.weights.any() and not model.factors.any() and model.bias < -30


def test_columns_named_like_those_in_between(spark, odd):
    model = toxicity.constant(-1.0)
    docs = odd.selectExpr("*", "1 AS _lowered_text", "2 AS _toxicity", "3 AS ________________score")
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()
