"""Activity events as a stream: de-duplication and the state machine."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from saltmarsh.operators.activity import CLOSING, RETAINED, TERMINAL, closed, execution_ends, retained
from saltmarsh.operators.rows import first_per_key

# Activities are spread over this many state groups, whatever their execution; a checkpoint keeps to its number.
SHARES = 256
# Activities whose states are read and written as one value; a leaf with more is dealt to as many leaves as FANOUT, by the next
# BITS of their places.
LEAF = 128
BITS = 3
FANOUT = 1 << BITS
LEVELS = 20
# States of the activities of a leaf, side by side, times in microseconds; none where the leaf was dealt out.
STATES = "dealt boolean, place array<bigint>, execution array<bigint>, activity array<string>, attempt array<int>, status array<string>, started array<bigint>"
# Rows on their way into Python and out of it, side by side: a value of a list is handed over at a fraction of the cost of a row's.
EVENTS = (
    "share int, place array<bigint>, execution array<bigint>, activity array<string>, event array<bigint>, status array<string>, micros array<bigint>"
)
CHANGES = (
    "execution_id array<bigint>, activity_id array<string>, attempt array<int>, status array<string>, started array<bigint>, "
    "updated array<bigint>, event_id array<bigint>"
)
NAMES = [part.split()[0] for part in CHANGES.split(", ")]
OUTPUT = (
    "execution_id bigint, activity_id string, attempt int, status string, started_at timestamp, "
    "completed_at timestamp, updated_at timestamp, event_id bigint"
)


def unique_stream(events: DataFrame) -> DataFrame:
    """First delivery of every event id, however late; the ids seen stay in the state store.

    Events without an id are all kept.
    """
    known = events.filter(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    return known.union(events.filter(F.col("event_id").isNull()))


def step(known: tuple | None, status: str, ts: int) -> tuple | None:
    """State (attempt, status, start) of an activity after one event; None when the event is ignored."""
    if known is None:
        return 1, status, ts
    attempt, current, started = known
    if current in TERMINAL and status == "running":
        return attempt + 1, status, ts
    if current in TERMINAL and status != current:
        return None
    return attempt, status, started


def side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each share in a batch, with lists of the other columns; ``share`` is the first column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.take(pc.sort_indices(batch.column(0)))
        shares = rows.column(0).to_numpy()
        starts = np.flatnonzero(np.diff(shares, prepend=-1))
        bounds = pa.array(np.append(starts, len(shares)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, column) for column in rows.columns[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(shares[starts]), *lists], names=batch.schema.names)


def child(node: int, place: int) -> int:
    """The node below, for an activity of this place. The root is 1, and a node's bits after its first are those its places share."""
    level = (node.bit_length() - 1) // BITS
    return node << BITS | place >> BITS * (LEVELS - level) & FANOUT - 1


class ActivityProcessor(StatefulProcessor):
    """Keeps the latest attempt of every activity of a group in a typed map.

    A call for a single value of the map costs much more than a state. So the map
    holds the leaves of a tree over the places (hashes) of activities, which grows by dealing
    out full leaves; leaves without events are neither read nor written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "node bigint", STATES)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        arrived: dict[tuple, list[tuple]] = {}
        for row in rows:
            for place, execution, name, event, status, ts in zip(row.place, row.execution, row.activity, row.event, row.status, row.micros):
                arrived.setdefault((place, execution, name), []).append((ts, event, status))
        yield from self.advance(1, arrived)

    def advance(self, node: int, arrived: dict[tuple, list[tuple]]) -> Iterator[Row]:
        """Changed attempts below a node."""
        held = self.known.getValue((node,))  # None if there is none
        if held is not None and held[0]:
            for below, part in self.dealt(node, arrived).items():
                yield from self.advance(below, part)
            return
        before = {} if held is None else {(p, e, a): tuple(state) for p, e, a, *state in zip(*held[1:])}
        states, out = dict(before), []
        for activity, events in arrived.items():
            _, execution, name = activity
            state, changed = states.get(activity), {}
            for ts, event, status in sorted(events):
                after = step(state, status, ts)
                if after is not None:
                    state = after
                    changed[after[0]] = after, ts, event
            if changed:
                states[activity] = state
            for (attempt, status, started), updated, event in changed.values():
                out.append((execution, f"{name}#{attempt}" if attempt > 1 else name, attempt, status, started, updated, event))
        if states != before:
            self.keep(node, states)
        if out:
            yield Row(**dict(zip(NAMES, map(list, zip(*out)))))

    def keep(self, node: int, states: dict[tuple, tuple]) -> None:
        """Store the states of a leaf, or of the leaves below if it has become too large."""
        if len(states) <= LEAF or node >> BITS * LEVELS:
            self.known.updateValue((node,), (False, *map(list, zip(*[activity + state for activity, state in states.items()]))))
            return
        self.known.updateValue((node,), (True, *[[]] * 6))
        for below, part in self.dealt(node, states).items():
            self.keep(below, part)

    @staticmethod
    def dealt(node: int, activities: dict[tuple, object]) -> dict[int, dict]:
        parts: dict[int, dict] = {}
        for activity, value in activities.items():
            parts.setdefault(child(node, activity[0]), {})[activity] = value
        return parts

    def close(self) -> None:
        pass


def state_stream(events: DataFrame, shares: int = SHARES) -> DataFrame:
    """Changed attempts per trigger. No event is dropped for lateness and no attempt is forgotten.

    Events count in the order of arrival and, within a trigger, of time. A group
    is a share of all activities, so there are few groups however many executions there are, and a
    busy execution is spread over all of them. The source's limit of files
    or bytes per trigger bounds what a group sees at once.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    spot = F.xxhash64("execution_id", "activity_id")
    rows = events.select(
        F.pmod(spot, F.lit(shares)).cast("int").alias("share"),
        F.shiftrightunsigned(spot, 1).alias("place"),
        F.col("execution_id").cast("bigint").alias("execution"),
        F.coalesce(F.col("activity_id").cast("string"), F.lit("None")).alias("activity"),
        F.col("event_id").cast("bigint").alias("event"),
        F.col("status").cast("string").alias("status"),
        micros.alias("micros"),
    )
    lists = rows.mapInArrow(side_by_side, EVENTS).groupBy("share").transformWithState(ActivityProcessor(), CHANGES, "Update", "None")
    changes = lists.select(F.inline(F.arrays_zip(*NAMES)))
    updated = F.timestamp_micros("updated")
    return changes.select(
        "execution_id",
        "activity_id",
        "attempt",
        "status",
        F.timestamp_micros("started").alias("started_at"),
        F.when(F.col("status").isin(*CLOSING), updated).alias("completed_at"),
        updated.alias("updated_at"),
        "event_id",
    )


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that typed state variables need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_states(states: DataFrame, path: str, checkpoint: str) -> None:
    """Run the stream over everything available. A repeated trigger overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    query = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    with typed_state(states.sparkSession):
        running = query.trigger(availableNow=True).start()
    running.awaitTermination()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The last written state of every attempt."""
    rows = spark.read.schema(OUTPUT + ", trigger int").parquet(path)
    return first_per_key(rows, ["execution_id", "activity_id"], [-F.col("trigger")]).drop("trigger")


def execution_stream(events: DataFrame) -> DataFrame:
    """Executions with new events per trigger, as :func:`saltmarsh.operators.activity.close_executions` gives them.

    First and last event are aggregates, so a busy execution is combined in the tasks that read it.
    """
    return closed(execution_ends(events))


def write_retained(executions: DataFrame, path: str, checkpoint: str, limit: int = RETAINED) -> None:
    """Keep the most recently started executions of a stream of them.

    Each trigger merges the executions that changed with those kept so far, a bounded table, into
    its own folder, so a repeated trigger gives the same again. It equals the batch form as long as no
    event comes in that lies before the start of an execution that is kept.
    """
    spark = executions.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        changed = batch.select(*executions.columns)
        if number:
            kept = spark.read.schema(executions.schema).parquet(f"{path}/trigger={number - 1}")
            changed = changed.union(kept.join(changed.select("execution_id"), "execution_id", "left_anti").select(*changed.columns))
        retained(changed, limit).write.mode("overwrite").parquet(f"{path}/trigger={number}")

    query = executions.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    query.foreachBatch(save).trigger(availableNow=True).start().awaitTermination()


def kept_executions(spark: SparkSession, path: str) -> DataFrame:
    """Executions kept after the last trigger."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("trigger")).first()[0]
    return rows.filter(F.col("trigger") == last).drop("trigger")
