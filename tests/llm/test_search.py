"""Vector searches against brute force."""

import numpy as np
import pytest

from saltmarsh.llm import exact, neighbours, vectors

SCHEMA = "vec_id long, embedding array<float>, rank int, id string"


def frame(spark, vectors_):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in vectors_], SCHEMA)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    random = np.random.default_rng(2)
    own = [(i, random.normal(size=8).astype(np.float32).tolist()) for i in range(1, 700)]
    same = random.normal(size=8).astype(np.float32).tolist()
    own += [(i, same) for i in range(700, 1000)]  # a large group of copies
    own += [(1000, None), (1050, [1.0] * 7 + [None]), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, [1.0, 2.0])]
    own += [(1250, [0.0] * 8), (None, same), (50, own[49][1]), (0, [1e-30] * 8)]
    return own


def usable(rows, zero):
    found = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            found.setdefault(i, v)
    return found


def test_exact(spark, odd_vectors):
    rows = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in usable(odd_vectors, True).items()}
    found = exact.top_k(frame(spark, odd_vectors), every=50, k=10).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in rows if i % 50 == 0}
    for q, ranks in got.items():
        scores = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)[:10]
        assert [ranks[n] for n in range(1, 11)] == [(i, -s) for s, i in scores]


def test_exact_in_several_shards(spark, odd_vectors, monkeypatch):
    whole = exact.top_k(frame(spark, odd_vectors), every=50, k=10).collect()
    monkeypatch.setattr(exact, "SHARD_ROWS", 100)
    monkeypatch.setattr(exact, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(exact, "LEAF_ROWS", 8)
    assert sorted(exact.top_k(frame(spark, odd_vectors), every=50, k=10).collect()) == sorted(whole)


def test_ball_tree_search_with_huge_values():
    random = np.random.default_rng(0)
    points = np.floor(random.normal(size=(300, 4)) * 1e12)
    found = exact.search_shard(np.arange(300), points, np.array([5]), points[5:6], np.array([-np.inf]), 3)
    whole = sorted(((-sum(int(a) * int(b) for a, b in zip(points[5], p)), i) for i, p in enumerate(points) if i != 5))[:3]
    assert found[1].tolist() == [i for _, i in whole]


def test_neighbours(spark, odd_vectors):
    rows = usable(odd_vectors, False)
    found = neighbours.nearest(frame(spark, odd_vectors), every=50, k=5).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in rows if i % 50 == 0}
    hit = 0
    for q, ranks in got.items():
        a = np.array(rows[q], float)
        cosine = lambda v: float(a @ np.array(v) / np.sqrt(a @ a) / np.sqrt(np.array(v) @ np.array(v)))
        best = sorted((-round(cosine(v), 12), i) for i, v in rows.items() if i != q)[:5]
        hit += len({i for _, i in best} & {i for i, _ in ranks.values()})
        assert all(score == pytest.approx(cosine(rows[i]), abs=1e-12) for i, score in ranks.values())
        order = [(-s, i) for _, (i, s) in sorted(ranks.items())]
        assert order == sorted(order)
    assert hit / (5 * len(got)) >= 0.9


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    own = table.toPandas().set_index("vec_id").embedding
    points = neighbours.unit(np.stack(own.to_numpy()).astype(float))
    found = neighbours.nearest(table, every=50, k=5).toPandas()
    hit = 0
    for q, part in found.groupby("query_id"):
        near = points @ points[own.index.get_loc(q)]
        order = [i for i in own.index[np.lexsort((own.index, -near))] if i != q][:5]
        hit += len(set(order) & set(part.vec_id))
    assert hit / len(found) >= 0.9


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, None), (50, [0.0])], [(0, [1.0]), (1, [2.0])]])
def test_few_rows(spark, rows):
    wanted = 1 if len(rows) == 2 and rows[0][1] else 0
    assert neighbours.nearest(frame(spark, rows)).count() == wanted
    assert exact.top_k(frame(spark, rows)).count() == wanted


def test_surplus_copies(spark):
    rows = spark.createDataFrame([(i, [1.0]) for i in range(200)] + [(i, [2.0]) for i in range(200, 203)], "id long, v array<double>")
    kept = sorted(r.id for r in vectors.without_surplus_copies(rows, 3).collect())
    assert kept == [0, 1, 2, 3, 200, 201, 202]
