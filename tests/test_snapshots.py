"""Versions of a keyed store: whole reads during updates, two writers, clean-up."""

import os
import time

import pytest

from pyspark.sql import functions as F

from saltmarsh.sources import snapshots

SCHEMA = "k bigint, v string"


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshots.write(spark.createDataFrame([(i, "old") for i in range(100)], SCHEMA), path, "k")
    return path


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("policy,wanted", [("keep", {(1, "a"), (2, "b"), (3, "C")}), ("replace", {(1, "a"), (2, "B"), (3, "C")})])
def test_update(spark, tmp_path, policy, wanted):
    path = str(tmp_path / "store")
    snapshots.write(rows(spark, (1, "a"), (2, "b")), path, "k")
    assert snapshots.update(spark, path, rows(spark, (2, "B"), (3, "C")), policy) == 2
    assert set(held(snapshots.read(spark, path))) == wanted
    snapshots.update(spark, path, rows(spark, (2, "x"), (2, "y")), "groups")
    assert set(held(snapshots.read(spark, path))) == {w for w in wanted if w[0] != 2} | {(2, "x"), (2, "y")}
    assert set(held(snapshots.read(spark, path, version=2))) == wanted


def test_reader_during_an_update_sees_the_old_store(spark, store, monkeypatch):
    """New folders are complete, the commit is not there yet."""
    before = snapshots.read(spark, store)
    seen, commit = [], snapshots._commit

    def watched(*args):
        seen.append(held(snapshots.read(spark, store)))
        commit(*args)

    monkeypatch.setattr(snapshots, "_commit", watched)
    snapshots.update(spark, store, rows(spark, *[(i, "new") for i in range(0, 200, 2)]), "replace")
    old = sorted([(i, "old") for i in range(100)], key=str)
    assert seen == [old] and held(before) == old
    expected = {i: "old" for i in range(100)} | {i: "new" for i in range(0, 200, 2)}
    assert held(snapshots.read(spark, store)) == sorted(expected.items(), key=str)


def test_second_writer_merges_again(spark, store, monkeypatch):
    commit, others = snapshots._commit, [(3, "first writer"), (500, "first writer")]

    def raced(*args):
        if others:
            pairs, others[:] = list(others), []
            snapshots.update(spark, store, rows(spark, *pairs), "replace")
        commit(*args)

    monkeypatch.setattr(snapshots, "_commit", raced)
    assert snapshots.update(spark, store, rows(spark, (3, "second writer"), (4, "second writer")), "replace") == 3
    found = dict(held(snapshots.read(spark, store)))
    assert (found[3], found[4], found[500], len(found)) == ("second writer", "second writer", "first writer", 101)


def test_commits_never_replace_one_another(spark, store):
    now = snapshots.snapshot(spark, store)
    with pytest.raises(snapshots.Conflict):
        snapshots._commit(spark, store, now)
    with pytest.raises(snapshots.Conflict):
        snapshots.write(rows(spark, (1, "x")), store, "k")
    assert snapshots.versions(spark, store) == [1] and not [n for n in os.listdir(f"{store}/commits") if "0" not in n]
    with pytest.raises(ValueError):
        snapshots.read(spark, store, version=9)


def test_untouched_buckets_keep_their_files(spark, store):
    one = snapshots.snapshot(spark, store).folders
    snapshots.update(spark, store, rows(spark, (7, "new")), "replace")
    two = snapshots.snapshot(spark, store).folders
    assert sum(one[b] != two[b] for b in one) == 1 and len(one) == len(two) > 30
    assert snapshots.update(spark, store, rows(spark).limit(0), "replace") == 2


def test_clean_up(spark, store):
    for n in range(3):
        snapshots.update(spark, store, rows(spark, *[(i, f"v{n}") for i in range(n, 100, 3)]), "replace")
    now = held(snapshots.read(spark, store))
    assert snapshots.clean(spark, store) > 0 and snapshots.versions(spark, store) == [3, 4]
    assert held(snapshots.read(spark, store)) == now and len(held(snapshots.read(spark, store, version=3))) == 100
    with pytest.raises(ValueError):
        snapshots.read(spark, store, version=1)


def test_one_key_with_most_rows_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "hot")
    # So few rows would be put together again otherwise.
    monkeypatch.setattr(snapshots, "SPREAD", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    frame = spark.range(4000).select(F.lit(1).cast("bigint").alias("k"), F.col("id").cast("string").alias("v"))
    snapshots.write(frame, path, "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (folder,) = snapshots.snapshot(spark, path).folders.values()
    assert len([f for f in os.listdir(f"{path}/{folder}") if f.endswith(".parquet")]) > 3
    assert snapshots.read(spark, path).distinct().count() == 4000


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "none")
    snapshots.write(rows(spark).limit(0), path, "k")
    assert held(snapshots.read(spark, path)) == []
    snapshots.update(spark, path, rows(spark, (None, "no key"), (1, "x")))
    assert held(snapshots.read(spark, path)) == [(1, "x"), (None, "no key")]


@pytest.mark.parametrize("policy", ["replace", "groups"])
def test_fresh_rows_are_written_once(spark, store, monkeypatch, policy):
    """Fresh rows go to their buckets at once; no copy of them is kept beside the store."""
    monkeypatch.setattr(snapshots, "materialise", lambda *args: pytest.fail("a copy of the updates"))
    monkeypatch.setattr(snapshots, "GROUP_BYTES", 1)  # buckets are merged a few at a time
    fresh = [(i, "new") for i in range(0, 200, 2)] + [(None, "no key")]
    assert snapshots.update(spark, store, rows(spark, *fresh), policy) == 2
    wanted = [(i, "old") for i in range(1, 100, 2)] + fresh
    assert held(snapshots.read(spark, store)) == sorted(wanted, key=str)
    assert snapshots.update(spark, store, rows(spark, (None, "nor here")), policy) == 3
    assert held(snapshots.read(spark, store)) == sorted([*wanted, (None, "nor here")], key=str)


def test_groups_of_buckets(spark, store, monkeypatch):
    folders = snapshots.snapshot(spark, store).folders
    assert snapshots._groups(spark, store, folders) == [sorted(folders)]
    monkeypatch.setattr(snapshots, "GROUP_BYTES", 1)
    groups = snapshots._groups(spark, store, folders)
    assert sorted(b for g in groups for b in g) == sorted(folders) and snapshots.GROUPS // 2 <= len(groups) <= snapshots.GROUPS


def test_finish_adds_columns_to_dealt_rows(spark, tmp_path):
    path = str(tmp_path / "finished")
    finish = lambda frame: frame.withColumn("length", F.length("v"))
    snapshots.write(rows(spark, (1, "a"), (2, "bb")), path, "k", finish=finish)
    for policy, pair in (("groups", (2, "ccc")), ("keep", (3, "dddd"))):
        snapshots.update(spark, path, rows(spark, pair), policy, finish=finish)
    assert held(snapshots.read(spark, path)) == [(1, "a", 1), (2, "ccc", 3), (3, "dddd", 4)]


def test_shuffle_files_go_with_their_write(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(disk.getAllFiles().apply(i).getName().startswith("shuffle_") for i in range(disk.getAllFiles().size()))
    setting = spark.conf.get(snapshots.CLEANUP)
    before = shuffled()
    snapshots.write(rows(spark, *[(i, "x" * 50) for i in range(500)]), str(tmp_path / "store"), "k")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before and spark.conf.get(snapshots.CLEANUP) == setting


def test_texts_of_both_kinds_are_shuffled_once(spark, small):
    """Labelled and other documents of an index come out of one shuffle of the texts."""
    from saltmarsh.catalog import retrieval
    from saltmarsh.catalog.base import Tables

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = retrieval.document_index(Tables(spark, small), 16).select("id", "text")
        index.collect()
        assert "ReusedExchange" in index._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
