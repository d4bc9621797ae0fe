import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import evidence as ev, news, paging, ranking as rk
from saltmarsh.operators.rows import first_per_key, merge_by_key, number_rows, replace_groups, skip_existing
from saltmarsh.operators.vectorize import hash_vectors, model_vectors
from saltmarsh.plans.retrieval import evidence_context, hashing, retrieve


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_number_rows(spark, hot):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < hot else f"k{rng.randrange(50)}", i) for i in range(3000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, i int").repartition(7)
    got = {(r.k, r.i): r.row_id for r in number_rows(frame, ["k", "i"], slices=6).collect()}
    assert got == {key: n for n, key in enumerate(sorted(rows))}


def test_number_rows_with_nulls_and_without_rows(spark):
    frame = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "k string, i int")
    assert [(r.i, r.row_id) for r in number_rows(frame, ["k", "i"], slices=3).orderBy("row_id").collect()] == [(1, 0), (3, 1), (2, 2)]
    assert number_rows(frame.limit(0), ["k", "i"]).count() == 0


def test_first_per_key(spark):
    rows = [("hot", i % 7 + 1, i) for i in range(1000)] + [("x", 1, None), (None, 2, 5)]
    frame = spark.createDataFrame(rows, "k string, o int, v int")
    got = {r.k: (r.o, r.v) for r in first_per_key(frame, ["k"], [F.col("o"), F.col("v")]).collect()}
    assert got == {"hot": (1, 0), "x": (1, None), None: (2, 5)}


def test_merge(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    keep = merge_by_key(base, new, ["k"])
    assert sorted(map(tuple, keep.collect())) == [(1, "a"), (2, "b"), (3, "C")]
    assert sorted(map(tuple, merge_by_key(keep, new, ["k"]).collect())) == sorted(map(tuple, keep.collect()))
    replaced = merge_by_key(base, new, ["k"], "replace")
    assert sorted(map(tuple, replaced.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, skip_existing(new, base, ["k"]).collect())) == [(3, "C")]
    with pytest.raises(ValueError):
        merge_by_key(base, new, ["k"], "maybe")


def test_replace_groups(spark):
    base = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    assert sorted(map(tuple, replace_groups(base, new, "k").collect())) == [("a", 9), ("b", 3)]


@pytest.mark.parametrize("queries,k", [(3, 4), (300, 2)])
def test_nearest_is_exact(spark, queries, k):
    rng = np.random.default_rng(7)
    vectors = np.round(rng.normal(size=(400, 8)), 1).astype(np.float32)
    vectors[50:90] = vectors[10]  # ties are broken by key
    asked = vectors[:queries].astype(float)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").repartition(5)
    wanted = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id bigint, embedding array<double>")
    got = {}
    for r in rk.nearest(index, wanted, "vec_id", k=k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for i, q in enumerate(asked):
        gaps = ((vectors.astype(float) - q) ** 2).sum(axis=1)
        best = np.lexsort((np.arange(400), gaps))[:k]
        assert [v for _, v in sorted(got[i])] == best.tolist()


def test_nearest_of_nothing(spark):
    index = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    wanted = spark.createDataFrame([(1, [0.0, 1.0])], "query_id bigint, embedding array<double>")
    assert rk.nearest(index, wanted, "vec_id").count() == 0
    assert rk.nearest(wanted.withColumnRenamed("query_id", "vec_id"), wanted.limit(0), "vec_id").count() == 0


def test_thresholds(spark):
    rows = spark.createDataFrame([(3, 0.0, 0.9), (3, 0.5, 0.74), (3, 0.5, 0.75), (4, 0.0, 0.2), (4, 0.0, 0.19)], "n int, k double, r double")
    assert [r[0] for r in rows.select(rk.relevant(F.col("n"), F.col("k"), F.col("r"))).collect()] == [False, False, True, True, False]


def test_retrieval_matches_plain_search(spark):
    texts = [f"word{i} shared token{i % 5} text{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, t, "external_news" if i % 2 else "internal_document") for i, t in enumerate(texts)], "chunk_key bigint, text string, source_type string")
    index = hash_vectors(docs, dimensions=64)
    asked = spark.createDataFrame([(1, texts[7]), (2, texts[8])], "query_id bigint, text string")
    found = retrieve(index, asked, hashing(64), source_type="external_news", candidates=10, final=3).collect()
    assert {r["source_type"] for r in found} == {"external_news"}
    assert max((r for r in found if r["query_id"] == 1), key=lambda r: r["relevance_score"])["chunk_key"] == 7

    vectors = {r["chunk_key"]: np.array(r["embedding"], dtype=float) for r in index.collect()}
    query = vectors[7]
    odd = [i for i in range(40) if i % 2]
    near = sorted(odd, key=lambda i: (((vectors[i] - query) ** 2).sum(), i))[:10]
    words = set(texts[7].split())
    score = {}
    for i in near:
        d = ((vectors[i] - query) ** 2).sum()
        share = min(1, len(words & set(texts[i].split())) / len(words))
        score[i] = 0.7 * np.exp(-(d**2) / (2 * 0.25**2)) + 0.3 * share
    want = [i for i in sorted(near, key=lambda i: (-score[i], near.index(i))) if score[i] >= 0.2][:3]
    assert [r["chunk_key"] for r in sorted(found, key=lambda r: r["final_rank"]) if r["query_id"] == 1] == want
    context = evidence_context(retrieve(index, asked, hashing(64), final=2)).filter("query_id = 1").first()["context"]
    assert context.startswith("\n[SOURCE 1]\nFile: unknown\nBucket: unknown") and "word7 shared" in context


def test_model_hook(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "i int, text string")
    got = model_vectors(docs, lambda texts: [[float(len(t)), 1.0] for t in texts]).orderBy("i").collect()
    assert [r["embedding"] for r in got] == [[2.0, 1.0], [0.0, 1.0]]


def test_paging(spark):
    frame = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3, f"Name.{i}") for i in range(20)], "i int, v int, n string")
    assert paging.search_rows(frame, "NAME.1").count() == 11
    assert paging.search_rows(frame, "nan").count() == 0
    rows = paging.sort_rows(frame, "v", descending=True, tiebreak=["i"])
    order = [r.i for r in rows.collect()]
    assert order[-5:] == [0, 4, 8, 12, 16]
    assert [r.i for r in paging.page_rows(rows, 2, 6).collect()] == order[6:12]
    assert tuple(paging.page_info(frame.limit(0), 1, 6).first()) == (0, 1, 6, 1)
    with pytest.raises(ValueError):
        paging.preview(frame, 101, "i")


def test_evidence_ids_beyond_three_digits(spark):
    numbered = ev.number_evidence(spark.range(1200), ["id"], F.lit("s"))
    ids = {r["id"]: r["evidence_id"] for r in numbered.collect()}
    assert (ids[0], ids[998], ids[999], ids[1199]) == ("evidence_001", "evidence_999", "evidence_1000", "evidence_1200")


def test_good_sources_keep_first(spark):
    rows = [(1, "a", 0.1), (2, "a", 0.5), (3, "a", 0.9), (4, "", 0.9), (5, None, 0.9), (6, "b", None)]
    frame = spark.createDataFrame(rows, "pos int, url string, relevance double")
    assert [(r.identity, r.pos) for r in ev.good_sources(frame, ["pos"]).collect()] == [("a", 2)]


def test_topics(spark):
    rows = [("A", "Positive", "2024-01-02"), ("A", "odd", "2024-01-03"), (None, None, "2024-01-01"), ("", "NEGATIVE", None)]
    got = news.topic_summary(spark.createDataFrame(rows, "topic string, impact string, collected_at string")).collect()
    assert [tuple(r) for r in got] == [("A", 2, 1, 0, 1, "2024-01-03"), ("General News", 2, 0, 1, 1, "2024-01-01")]
    plain = news.topic_summary(spark.createDataFrame([("A", "x")], "topic string, collected_at string")).first()
    assert plain["neutral"] == 1


def test_nearest_with_text_ids_and_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(rk, "QUERY_BLOCK", 3)
    index = spark.createDataFrame([(f"k{i}", [float(i), 0.0]) for i in range(30)] + [("none", None)], "name string, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", [i + 0.1, 0.0]) for i in range(10)], "query_id string, embedding array<double>")
    found = rk.nearest(index, asked, "name", k=1).collect()
    assert sorted((r.query_id, r.name, r["rank"]) for r in found) == [(f"q{i}", f"k{i}", 1) for i in range(10)]


def test_nearest_of_many_queries_makes_few_frames_and_holds_few_distances(monkeypatch):
    """No frame for each query, no matrix of all queries and rows, and still the k nearest, ties by key."""
    import tracemalloc

    import pandas as pd

    vectors = np.random.default_rng(4).integers(0, 3, (6000, 4)).astype(float)  # many ties
    rows = pd.DataFrame({"key": np.random.default_rng(5).permutation(6000), "vector": list(vectors)})
    asked = pd.DataFrame({"query_id": np.arange(2000), "vector": list(vectors[:2000] + 0.25)})
    made, frame = [], pd.DataFrame
    monkeypatch.setattr(pd, "DataFrame", lambda *args, **named: made.append(1) or frame(*args, **named))
    tracemalloc.start()
    found = rk._nearest_in_block(3, "name")(rows, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) < 100 and peak < 60e6
    got = found.groupby("query_id")["name"].agg(list)
    for i in range(0, 2000, 97):
        gaps = np.square(vectors - asked["vector"][i]).sum(1)
        assert got[i] == list(rows["key"].to_numpy()[np.lexsort((rows["key"], gaps))[:3]])


def test_block_counts():
    """Blocks are bounded, and their number does not multiply the rows that are sent."""
    assert rk._block_counts(10_000, 10_000, 24) == (7, 7)
    rows, queries = rk._block_counts(1 << 20, 1 << 20, 12)
    assert rows == queries == (1 << 20) // rk.BLOCK
    assert rk._block_counts(1000, 100_000, 8) == (1, 16)


def test_nearest_refuses_other_widths(spark):
    index = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "id bigint, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="different widths"):
        rk.nearest(index, asked, "id").collect()


def test_number_ordered(spark):
    from saltmarsh.operators.rows import number_ordered

    rows = spark.range(500).repartition(7).orderBy("id")
    assert [(r.id, r.row_id) for r in number_ordered(rows).orderBy("id").collect()] == [(i, i) for i in range(500)]


def test_stored_pages(spark, tmp_path):
    rows = [(i, None if i % 11 == 0 else i % 4) for i in range(500)]
    frame = spark.createDataFrame(rows, "k int, v int").repartition(6)
    path = str(tmp_path / "ordered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    paging.store_ordered(frame, path, F.desc_nulls_last("v"), "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for page in (1, 2, 13, 25, 26):
        got = [(r.k, r.v, r.position) for r in paging.open_page(spark, path, page, 20).collect()]
        assert got == [(*r, 20 * page - 20 + i) for i, r in enumerate(wanted[20 * page - 20 : 20 * page])]
    assert tuple(paging.stored_info(spark, path, 3, 40).first()) == (500, 3, 40, 13)
    plan = paging.open_page(spark, path, 2, 20)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan.split("PartitionFilters", 1)[1].split("PushedFilters", 1)[0]
    paging.store_ordered(frame.limit(0), f"{path}-none", "k")
    assert paging.open_page(spark, f"{path}-none", 1, 5).collect() == [] and paging.stored_info(spark, f"{path}-none", 1, 5).first()["pages"] == 1
    with pytest.raises(ValueError):
        paging.open_page(spark, path, 0, 5)


def test_vectors_counted_in_pieces(spark, monkeypatch):
    """Pieces of a few rows or tokens give what whole batches give."""
    from saltmarsh.operators import vectorize

    texts = [None, "", "a b a", "long " * 300 + "tail", "x y z"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    whole = [hash_vectors(docs, dimensions=16, kind=kind).collect() for kind in ("float", "double")]
    monkeypatch.setattr(vectorize, "PIECE", 50)
    assert whole == [hash_vectors(docs, dimensions=16, kind=kind).collect() for kind in ("float", "double")]
    assert all(len(r.embedding) == 16 and abs(sum(x * x for x in r.embedding) - bool(r.text)) < 1e-6 for rows in whole for r in rows)


def test_components_come_from_digest_bytes(spark):
    import hashlib

    texts = ["The cat, the-cat 9", "", None, "É --", "x " * 300_000, "a b c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string").coalesce(1)
    made = hash_vectors(docs, dimensions=1000, kind="double")
    for n, _, vector in made.collect():
        counts = [0] * 1000
        for token in re.findall("[a-z0-9][a-z0-9-]*", (texts[n] or "").lower()):
            counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 1000] += 1
        length = sum(c * c for c in counts) ** 0.5 or 1
        assert vector == [c / length for c in counts]
    # No number is parsed for a token.
    assert "conv(" not in made._jdf.queryExecution().optimizedPlan().toString()
