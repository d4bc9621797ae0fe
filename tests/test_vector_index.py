"""The inverted file: exact searches equal scans, quick ones reach their recall, changed objects replace their rows."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from saltmarsh.operators import vector_index as vi

ROWS = "vec_id bigint, object string, label int, embedding array<float>"


def clustered(count, width=16, seed=3):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(count // 60 + 1, width))
    return (centres[random.integers(0, len(centres), count)] + random.normal(0, 0.25, (count, width))).astype(np.float32)


def frame(spark, vectors, first=0):
    rows = [(first + i, f"o{(first + i) // 5}", (first + i) % 3, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, ROWS).repartition(4)


def asked(spark, vectors):
    return spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(vectors)], "query_id bigint, embedding array<double>")


def plain(vectors, keys, queries, k):
    out = {}
    for i, q in enumerate(queries):
        gaps = ((vectors.astype(float) - q.astype(float)) ** 2).sum(1)
        out[i] = [int(keys[j]) for j in np.lexsort((keys, gaps))[:k]]
    return out


def found(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r["key"])
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    vectors = clustered(3000)
    vectors[100:120] = vectors[7]  # ties are broken by key
    path = str(tmp_path_factory.mktemp("index"))
    vi.build(frame(spark, vectors), path, "vec_id", object_key="object", carried=["label"])
    return path, vectors


def test_exact_search_equals_a_scan(spark, built):
    path, vectors = built
    queries = np.concatenate([vectors[:40], np.random.default_rng(1).normal(size=(5, 16)).astype(np.float32)])
    result = vi.search(spark, path, asked(spark, queries), 10, exact=True)
    assert found(result) == plain(vectors, np.arange(3000), queries, 10)
    exact = ((vectors[result.filter("query_id = 41 AND rank = 1").first()["key"]].astype(float) - queries[41]) ** 2).sum()
    assert result.filter("query_id = 41 AND rank = 1").first()["distance"] == pytest.approx(exact)


def test_quick_search_reaches_its_recall(spark, built):
    path, vectors = built
    queries = clustered(200, seed=3)[:200] + np.random.default_rng(5).normal(0, 0.1, (200, 16)).astype(np.float32)
    quick = found(vi.search(spark, path, asked(spark, queries), 10, visited=8))
    exact = plain(vectors, np.arange(3000), queries, 10)
    recall = np.mean([len(set(quick[i]) & set(exact[i])) / 10 for i in exact])
    assert recall >= 0.95, recall


def test_filter_before_the_search(spark, built):
    path, vectors = built
    keys = np.arange(1, 3000, 3)
    result = vi.search(spark, path, asked(spark, vectors[:10]), 7, where=F.col("label") == 1, exact=True)
    assert found(result) == plain(vectors[keys], keys, vectors[:10], 7)
    assert vi.search(spark, path, asked(spark, vectors[:3]), 7, where=F.col("label") == 9, exact=True).count() == 0


def test_changed_objects_replace_their_rows(spark, tmp_path):
    vectors = clustered(900, seed=8)
    path = str(tmp_path / "index")
    vi.build(frame(spark, vectors), path, "vec_id", object_key="object", carried=["label"])
    # Objects 0 to 99 are indexed anew with one vector in place of five; new ones come in far away.
    fresh = clustered(100, seed=9) + 5
    kept = spark.createDataFrame([(5 * i, f"o{i}", 0, v.tolist()) for i, v in enumerate(fresh)], ROWS)
    assert vi.update(kept, path, "vec_id", object_key="object", carried=["label"]) == 2
    now = np.concatenate([fresh, vectors[500:]])
    keys = np.concatenate([np.arange(0, 500, 5), np.arange(500, 900)])
    queries = np.concatenate([fresh[:5], vectors[:5], vectors[600:605]])
    assert found(vi.search(spark, path, asked(spark, queries), 6, exact=True)) == plain(now, keys, queries, 6)


@pytest.mark.parametrize("count", [1, 2, 130])
def test_few_rows(spark, tmp_path, count):
    vectors = clustered(count)
    path = str(tmp_path / "index")
    rows = frame(spark, vectors).union(spark.createDataFrame([(999, "none", 0, None)], ROWS))
    vi.build(rows, path, "vec_id")
    assert found(vi.search(spark, path, asked(spark, vectors[:1]), 5, exact=True)) == plain(vectors, np.arange(count), vectors[:1], 5)
    assert vi.search(spark, path, asked(spark, vectors[:1]), 5).count() == min(5, count)


def test_long_lists_are_cut_in_parallel(spark, tmp_path, monkeypatch):
    """Two first-level centroids only: the second level keeps lists short."""
    monkeypatch.setattr(vi, "COARSE", 2)
    monkeypatch.setattr(vi, "SLICE", 50)
    vectors = clustered(2000, seed=4)
    path = str(tmp_path / "index")
    vi.build(frame(spark, vectors), path, "vec_id")
    sizes = [r["count"] for r in vi.snapshots.read(spark, f"{path}/rows").groupBy("list_id").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 1000
    assert found(vi.search(spark, path, asked(spark, vectors[:20]), 5, exact=True)) == plain(vectors, np.arange(2000), vectors[:20], 5)


def test_other_widths_are_refused(spark, built):
    with pytest.raises(Exception, match="different widths"):
        vi.update(spark.createDataFrame([(1, "o", 0, [1.0, 2.0])], ROWS), built[0], "vec_id", object_key="object", carried=["label"])


def test_clusters_of_equal_points():
    assert len(vi.cluster(np.ones((50, 3)), 8)) == 1
    points = np.repeat(np.eye(4), 10, axis=0)
    assert len(vi.cluster(points, 4)) == 4


def test_fitting_holds_a_block_of_distances():
    """Distances of a sample to all centres are held block by block, and the centres are those of all at once."""
    import tracemalloc

    points = np.random.default_rng(5).normal(size=(1 << 13, 8))
    own, gap = vi.nearest(points, points[:64])
    every = vi.distances(points, points[:64])
    assert (own == every.argmin(1)).all() and np.allclose(gap, every.min(1))
    tracemalloc.start()
    vi.cluster(points, 1024, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


@pytest.mark.parametrize("exact", [False, True])
def test_many_blocks_of_queries(spark, built, monkeypatch, exact):
    """Cut into many blocks, parts and pieces a search finds what it finds in one block, for repeated queries too."""
    path, vectors = built
    queries = asked(spark, vectors[:60]).union(asked(spark, vectors[:2])).repartition(3)
    want = sorted(map(tuple, vi.search(spark, path, queries, 5, exact=exact).collect()))
    for name, value in {"QUERY_BLOCK": 16, "PIECE": 20, "PAIRS": 300, "CODED": 1, "SLICE": 150}.items():
        monkeypatch.setattr(vi, name, value)
    assert sorted(map(tuple, vi.search(spark, path, queries, 5, exact=exact).collect())) == want
    assert {r[3] for r in want} == {1, 2, 3, 4, 5} and len(want) == 300


def test_search_passes_on_few_rows_for_a_query(spark, built, monkeypatch):
    """A query leaves the scan of codes with the rows it measures, not with as many from every list."""
    path, vectors = built
    seen, by_code = [], vi._by_code
    monkeypatch.setattr(vi, "_by_code", lambda *args: seen.append(by_code(*args)) or seen[-1])
    vi.search(spark, path, asked(spark, vectors[:50]), 2, measured=4).count()
    rows = seen[0].collect()
    assert len(rows) == 50 and {len(r["key"]) for r in rows} == {8}


def test_text_ids(spark, tmp_path):
    vectors = clustered(300, seed=6)
    path = str(tmp_path / "index")
    named = frame(spark, vectors).withColumn("vec_id", F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 3, "0")))
    vi.build(named, path, "vec_id", object_key="object", carried=["label"])
    queries = asked(spark, vectors[:20]).withColumn("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    got = {(r.query_id, r.key, r["rank"]) for r in vi.search(spark, path, queries, 4, exact=True).collect()}
    want = plain(vectors, np.arange(300), vectors[:20], 4)
    assert got == {(f"q{i}", f"v{key:03d}", n + 1) for i, keys in want.items() for n, key in enumerate(keys)}
