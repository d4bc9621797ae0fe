"""First delivery of every event, with a flat state: ids seen lie in a store by bucket, behind Bloom filters.

A stream that keeps every id in its state grows for ever, and one that forgets old
ids lets late copies through. Here each trigger writes the ids that were new to it,
by bucket, and a Bloom filter for each bucket. The next triggers test their ids against the
filters, some ten bits for each id of the past, and only those that may have been
seen are looked up among the ids themselves. Nothing is forgotten, however late a
copy comes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from saltmarsh.operators.rows import first_per_key, materialise

BUCKETS = 16
# Bits of a filter for each id, and places of one id; about one id in a hundred is looked up in vain.
BITS = 10
PLACES = 6

_BLOOM = "bucket int, bits binary"


def _places(frame: pd.DataFrame, size: int) -> np.ndarray:
    """Bit numbers of each id, a row for each."""
    one, two = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("one", "two"))
    with np.errstate(over="ignore"):
        return (one[:, None] + np.arange(1, PLACES + 1, dtype=np.uint64) * (two | np.uint64(1))[:, None]) % np.uint64(size)


def _filter_of(frame: pd.DataFrame) -> pd.DataFrame:
    size = -(-max(len(frame) * BITS, 64) // 8) * 8
    bits = np.zeros(size, bool)
    bits[_places(frame, size).reshape(-1).astype(np.int64)] = True
    return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})


def _maybe_seen(frame: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    seen = np.zeros(len(frame), bool)
    for raw in filters["bits"] if len(frame) else ():
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
        seen |= bits[_places(frame, len(bits)).astype(np.int64)].all(1)
    return frame.loc[seen, ["bucket", "id"]]


def _ids(events: DataFrame, key: str) -> DataFrame:
    id_ = F.col(key)
    return events.select(
        F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int").alias("bucket"), id_.alias("id"),
        F.xxhash64(id_, F.lit(1)).alias("one"), F.xxhash64(id_, F.lit(2)).alias("two"),
    )


def write_unique(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", time: str = "ts") -> None:
    """Run the stream over everything available; each event id is written once, events without an id always.

    Within a trigger the earliest delivery counts. A repeated trigger reads what the triggers before
    it have written and overwrites its own folders, so it writes the same again.
    """
    spark = events.sparkSession
    id_type = events.schema[key].dataType.simpleString()

    def save(batch: DataFrame, number: int) -> None:
        named = batch.filter(F.col(key).isNotNull())
        fresh = materialise(first_per_key(named, [key], [F.col(time)]).select(*batch.columns), "arrived")
        if number:
            filters = spark.read.schema(_BLOOM + ", trigger int").parquet(f"{path}/filters").filter(F.col("trigger") < number)
            asked = _ids(fresh, key).groupBy("bucket").cogroup(filters.select("bucket", "bits").groupBy("bucket"))
            likely = materialise(asked.applyInPandas(_maybe_seen, f"bucket int, id {id_type}"), "likely")
            known = spark.read.schema(f"id {id_type}, trigger int, bucket int").parquet(f"{path}/ids").filter(F.col("trigger") < number)
            # Usually few, so that the planner sends them to the store and not the store to them.
            seen = known.join(likely, ["bucket", "id"], "left_semi").select(F.col("id").alias(key))
            fresh = materialise(fresh.join(seen, key, "left_anti").select(*batch.columns), "fresh")
        fresh.unionByName(batch.filter(F.col(key).isNull())).write.mode("overwrite").parquet(f"{path}/events/trigger={number}")
        ids = _ids(fresh, key)
        ids.select("bucket", "id").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/ids/trigger={number}")
        ids.groupBy("bucket").applyInPandas(_filter_of, _BLOOM).write.mode("overwrite").parquet(f"{path}/filters/trigger={number}")

    query = events.writeStream.option("checkpointLocation", checkpoint)
    query.foreachBatch(save).trigger(availableNow=True).start().awaitTermination()


def unique_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/events").drop("trigger")
