"""Targets against reshared weights, draws against their distribution."""

import math
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from saltmarsh.llm import mixing


def reshared(sizes):
    """Targets by sharing again and again what lies above a cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def words(text):
    return len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w])


def test_targets_and_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mix(docs).toPandas()
    texts = {r.doc_id: r for r in docs.collect()}
    assert sorted(found.doc_id) == sorted(texts)
    assert all(n == words(texts[i].text) for i, n in zip(found.doc_id, found["size"]))
    sizes = found.groupby("source")["size"].sum().to_dict()
    for source, target in reshared(sizes).items():
        own = found[found.source == source]
        assert own.target.iloc[0] == pytest.approx(target)
        assert abs(own.taken.sum() - target) < 0.01 * target
    assert (found.taken <= 2 * found["size"]).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert found.set_index("doc_id").taken.to_dict() == again.set_index("doc_id").taken.to_dict()
    assert found.set_index("doc_id").draws.map(list).to_dict() == again.set_index("doc_id").draws.map(list).to_dict()


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_edges(request, name):
    docs = request.getfixturevalue(name)
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    wanted = reshared(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert r.taken == len(r.draws) * r.size <= 2 * r.size
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(len(r.draws) for r in found)


def test_hypergeometric_distribution(spark):
    everything, good, drawn, n = 40, 13, 17, 20_000
    picks = spark.range(n).select(
        mixing.hypergeometric(*[F.lit(x).cast("long") for x in (everything, good, drawn)], (F.col("id") + 0.5) / n).alias("x")
    )
    counts = Counter(r.x for r in picks.collect())
    for x in range(0, 14):
        wanted = math.comb(good, x) * math.comb(everything - good, drawn - x) / math.comb(everything, drawn)
        assert abs(counts[x] / n - wanted) < 2 / n


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 37), (2, 0), (3, 211)], "sid int, draws long")
    found = mixing.split_quotas(quotas, 4).toPandas()
    assert found.groupby("sid").draws.sum().to_dict() == {0: 1000, 1: 37, 2: 0, 3: 211}
    assert set(found.groupby("shard").draws.sum()) == {78} and found.shard.nunique() == 16
    assert (found.draws >= 0).all()
