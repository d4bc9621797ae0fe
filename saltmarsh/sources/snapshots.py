"""A keyed store in versions: readers see one version whole, updates rewrite only the buckets they touch.

Rows lie in folders by a hash of their key. A commit file names the folder of
every bucket; the commit with the highest number is the store. An update writes
new folders for the buckets it touches and then adds the next commit, which
leaves all other folders as they are. A reader takes one commit and keeps to its
folders, so it sees the store before an update or after it, never half of it.
Commits are renamed into place and never replace one another: of two writers that
started from one version the second is refused, and merges again with what the
first has left. Old versions stay readable until they are cleaned up.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from py4j.protocol import Py4JJavaError

from saltmarsh.operators.rows import materialise, merge_by_key

BUCKETS = 64
# Tasks that share the rows of one bucket, so that a key with most rows is not written by one.
SPREAD = 8
TRIES = 5
# An update merges buckets that hold about so many stored bytes at a time, in so many groups at most.
GROUP_BYTES = 1 << 27
GROUPS = 16
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Conflict(RuntimeError):
    """Another writer has committed first."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    key: str
    count: int
    schema: T.StructType
    folders: dict[int, str]


def _hadoop(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    place = fs.Path(path)
    return fs, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    _, place, system = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in _names(spark, f"{path}/commits") if n.isdigit()]


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The latest version, or the one asked for."""
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise ValueError(f"no version {'' if version is None else version} of a store in {path}")
    number = known[-1] if version is None else version
    fs, place, system = _hadoop(spark, f"{path}/commits/{number:012d}")
    stream = system.open(place)
    try:
        held = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    folders = {int(b): f for b, f in held["folders"].items()}
    return Snapshot(number, held["key"], held["count"], T.StructType.fromJson(held["schema"]), folders)


def _commit(spark: SparkSession, path: str, new: Snapshot) -> None:
    """Add a commit; :class:`Conflict` if one of this number exists."""
    body = {"key": new.key, "count": new.count, "schema": new.schema.jsonValue(), "folders": {str(b): f for b, f in new.folders.items()}}
    fs, temporary, system = _hadoop(spark, f"{path}/commits/.{uuid.uuid4().hex}")
    stream = system.create(temporary, False)
    stream.write(bytearray(json.dumps(body).encode()))
    stream.close()
    target = fs.Path(f"{path}/commits/{new.version:012d}")
    rename = getattr(fs, "Options$Rename")
    refuse = spark.sparkContext._gateway.new_array(rename, 1)
    refuse[0] = rename.NONE
    context = fs.FileContext.getFileContext(temporary.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(temporary), system.makeQualified(target), refuse)
    except (Py4JJavaError, PySparkException) as error:
        system.delete(temporary, False)
        if system.exists(target):
            raise Conflict(f"version {new.version} of {path} exists") from error
        raise


def _placed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files of a shuffle go when the write that needed them has ended, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _store(rows: DataFrame, folder: str) -> None:
    with _shuffles_removed(rows.sparkSession):
        rows.write.mode("append").option("compression", "zstd").partitionBy("key_bucket").parquet(folder)


def _write_buckets(placed: DataFrame, path: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> dict[int, str]:
    """Folders of the buckets that have rows."""
    folder = f"data/{uuid.uuid4().hex}"
    hashed = [f.name for f in placed.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    spread = F.pmod(F.xxhash64(*hashed), F.lit(SPREAD))
    dealt = placed.repartition("key_bucket", spread)
    _store(finish(dealt) if finish else dealt, f"{path}/{folder}")
    found = [n for n in _names(placed.sparkSession, f"{path}/{folder}") if n.startswith("key_bucket=")]
    return {int(n.partition("=")[2]): f"{folder}/{n}" for n in found}


def write(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A new store; :class:`Conflict` where there is one.

    ``finish`` adds columns to rows that were dealt to their buckets, so that wide ones are not shuffled.
    """
    spark = rows.sparkSession
    if versions(spark, path):
        raise Conflict(f"a store exists in {path}")
    folders = _write_buckets(_placed(rows, key, buckets), path, finish)
    _commit(spark, path, Snapshot(1, key, buckets, (finish(rows) if finish else rows).schema, folders))


def read(spark: SparkSession, path: str, version: int | None = None, held: Snapshot | None = None, only: list[int] | None = None) -> DataFrame:
    """Rows of one version, the latest unless told otherwise, or of some of its buckets."""
    held = held or snapshot(spark, path, version)
    folders = [f"{path}/{f}" for b, f in held.folders.items() if only is None or b in only]
    return spark.read.schema(held.schema).parquet(*folders) if folders else spark.createDataFrame([], held.schema)


def _groups(spark: SparkSession, path: str, folders: dict[int, str]) -> list[list[int]]:
    """Buckets in groups of about GROUP_BYTES, so that what a merge shuffles at once is a part of a large store."""
    sizes = {b: (place := _hadoop(spark, f"{path}/{f}"))[2].getContentSummary(place[1]).getLength() for b, f in folders.items()}
    most = max(GROUP_BYTES, -(-sum(sizes.values()) // GROUPS))
    groups, held = [], 0
    for bucket in sorted(sizes):
        if not groups or held >= most:
            groups.append([])
            held = 0
        groups[-1].append(bucket)
        held += sizes[bucket]
    return groups


def _replaced(spark: SparkSession, path: str, held: Snapshot, fresh: DataFrame, finish: Callable[[DataFrame], DataFrame] | None) -> tuple[dict[int, str], DataFrame]:
    """Folders of the touched buckets, which hold the fresh rows and the stored rows of other keys; the fresh rows as written.

    Stored rows go beside the fresh ones bucket by bucket, so neither is shuffled more than once.
    """
    folders = _write_buckets(fresh, path, finish)
    files = {b: [f"{path}/{f}/{n}" for n in _names(spark, f"{path}/{f}") if n.endswith(".parquet")] for b, f in folders.items()}
    written = lambda buckets: spark.read.schema(held.schema).parquet(*[f for b in buckets for f in files[b]])
    for group in _groups(spark, path, {b: f for b, f in held.folders.items() if b in folders}):
        stored = _placed(read(spark, path, held=held, only=group), held.key, held.count)
        kept = stored.join(written(group).select(held.key).distinct(), held.key, "left_anti")
        _store(kept, f"{path}/{folders[group[0]].rpartition('/')[0]}")
    return folders, written(folders) if folders else fresh


def update(spark: SparkSession, path: str, updates: DataFrame, policy: str = "keep", finish: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Upsert and return the new version; a writer that came second merges again.

    ``keep`` and ``replace`` merge one row per key; ``groups`` puts all updates of a key in the
    place of all its stored rows. ``finish`` is that of :func:`write`. An update without rows makes no version.
    """
    if policy not in ("keep", "replace", "groups"):
        raise ValueError(f"unknown policy {policy!r}")
    held = snapshot(spark, path)
    names = [n for n in held.schema.names if finish is None or n in updates.columns]
    fresh = _placed(updates.select(*names), held.key, held.count)
    if policy == "keep":
        fresh = materialise(finish(fresh) if finish else fresh, "updates")
        touched = [r["key_bucket"] for r in fresh.select("key_bucket").distinct().collect()]  # at most ``count`` numbers
    for _ in range(TRIES):
        if policy == "keep":
            stored = _placed(read(spark, path, held=held, only=touched), held.key, held.count)
            folders = _write_buckets(merge_by_key(stored, fresh, [held.key], policy), path) if touched else {}
        else:
            folders, written = _replaced(spark, path, held, fresh, finish)
            # What was written is not computed again.
            fresh, finish = _placed(written, held.key, held.count) if folders else fresh, None
        if not folders:
            return held.version
        kept = {b: f for b, f in held.folders.items() if b not in folders}
        new = Snapshot(held.version + 1, held.key, held.count, held.schema, kept | folders)
        try:
            _commit(spark, path, new)
            return new.version
        except Conflict:
            held = snapshot(spark, path)
    raise Conflict(f"other writers came first {TRIES} times in {path}")


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the oldest commits and all folders that no kept commit names; how many folders went.

    Call it when no update is running, since its folders are not named yet.
    """
    known = versions(spark, path)
    for number in known[:-keep]:
        _, place, system = _hadoop(spark, f"{path}/commits/{number:012d}")
        system.delete(place, False)
    named = {f for number in known[-keep:] for f in snapshot(spark, path, number).folders.values()}
    gone = 0
    for name in _names(spark, f"{path}/data"):
        inside = [f"data/{name}/{n}" for n in _names(spark, f"{path}/data/{name}") if n.startswith("key_bucket=")]
        unused = [f for f in inside if f not in named]
        for folder in unused if len(unused) < len(inside) else [f"data/{name}"]:
            _, place, system = _hadoop(spark, f"{path}/{folder}")
            system.delete(place, True)
        gone += len(unused)
    return gone
