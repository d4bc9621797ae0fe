import datetime as dt
import random

import pytest
from pyspark.sql import Row, functions as F

from saltmarsh.operators import activity as ac
from saltmarsh.streaming.activity import LEAF, ActivityProcessor, latest_states, state_stream, unique_stream, write_states

START = dt.datetime(2024, 1, 1)
SCHEMA = "execution_id bigint, activity_id string, event_id bigint, status string, ts timestamp_ntz"


def random_events(n, hot=0.4, seed=11):
    """A third and more of all events belong to one activity."""
    rng = random.Random(seed)
    states = ["running", "completed", "failed", "skipped", "pending"]
    rows = []
    for i in range(n):
        busy = rng.random() < hot
        when = START + dt.timedelta(seconds=rng.randrange(200_000))
        rows.append((1 if busy else rng.randrange(2, 9), "a" if busy else rng.choice("ab"), i, rng.choice(states), when))
    return rows


def plain_states(rows):
    """The state machine written as a loop."""
    known, out = {}, {}
    for execution, activity, event, status, ts in sorted(rows, key=lambda r: (r[4], r[2])):
        attempt, current, started = known.get((execution, activity), (1, None, None))
        if current in ("completed", "failed"):
            if status == "running":
                attempt, current, started = attempt + 1, None, None
            elif status != current:
                continue
        started = started or ts
        known[execution, activity] = (attempt, status, started)
        name = f"{activity}#{attempt}" if attempt > 1 else activity
        done = ts if status in ("completed", "failed", "skipped") else None
        out[execution, name] = (attempt, status, started, done, ts, event)
    return out


def as_dict(frame):
    columns = ("attempt", "status", "started_at", "completed_at", "updated_at", "event_id")
    return {(r["execution_id"], r["activity_id"]): tuple(r[c] for c in columns) for r in frame.collect()}


@pytest.mark.parametrize("slice_seconds", [600, 7200, 10_000_000])
def test_states_match_loop(spark, slice_seconds):
    rows = random_events(1500)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert as_dict(ac.activity_states(frame, slice_seconds)) == plain_states(rows)


def test_stream_matches_loop_over_several_triggers(spark, tmp_path):
    rows = sorted(random_events(600), key=lambda r: (r[4], r[2]))
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows[part * 200 : part * 200 + 200], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        write_states(state_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = latest_states(spark, str(tmp_path / "out"))
    got = got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at", "updated_at")})
    assert as_dict(got) == plain_states(rows)


class CountedMap(dict):
    """A state map that counts calls."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value


def test_states_are_read_and_written_in_leaves():
    processor, held = ActivityProcessor(), CountedMap()
    processor.init(type("Handle", (), {"getMapState": lambda *_: held})())
    rng, rows, got = random.Random(3), [], {}
    places = [rng.randrange(1 << 63) for _ in range(2000)]
    for trigger in range(3):
        picked = [(rng.randrange(2000), trigger * 4000 + i, rng.choice(["running", "completed", "failed"])) for i in range(4000)]
        when = {event: START + dt.timedelta(seconds=event // 5) for _, event, _ in picked}
        lists = zip(*[(places[a], a % 7, f"a{a}", event, status, int(when[event].timestamp())) for a, event, status in picked])
        changed = processor.handleInputRows((0,), iter([Row(**dict(zip(("place", "execution", "activity", "event", "status", "micros"), lists)))]), None)
        for row in changed:
            for execution, name, attempt, status, started, updated, event in zip(*row):
                got[execution, name] = attempt, status, started, updated, event
        rows += [(a % 7, f"a{a}", event, status, when[event]) for a, event, status in picked]
    wanted = {k: (n, s, int(b.timestamp()), int(u.timestamp()), e) for k, (n, s, b, _, u, e) in plain_states(rows).items()}
    assert got == wanted
    assert sum(len(v[1]) for v in held.values()) == len({r[:2] for r in rows}) and max(len(v[1]) for v in held.values()) <= LEAF
    # 12,000 events, each activity in nearly every trigger.
    assert held.calls < 1000


def test_stream_with_many_activities_in_one_group(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(3), f"a{rng.randrange(200)}", i, rng.choice(["running", "completed"]), START + dt.timedelta(seconds=i)) for i in range(1500)]
    for part in range(2):
        spark.createDataFrame(rows[part * 750 : part * 750 + 750], SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), shares=1)
        write_states(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = latest_states(spark, str(tmp_path / "out"))
    got = got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at", "updated_at")})
    assert as_dict(got) == plain_states(rows)


def test_unique_stream_in_any_order(spark, tmp_path):
    rows = random_events(60)
    rows.sort(key=lambda r: -r[4].timestamp())  # the latest arrive first
    lost_id = rows[0][:2] + (None,) + rows[0][3:]
    for part in range(3):
        own = rows[part * 20 : part * 20 + 20] + rows[:10] + [lost_id]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = unique_stream(source).writeStream.option("checkpointLocation", str(tmp_path / "check")).format("parquet")
    query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    found = [r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(i for i in found if i is not None) == list(range(60)) and found.count(None) == 3


def test_a_late_event_counts_when_it_arrives(spark, tmp_path):
    day = dt.timedelta(days=1)
    arrivals = [
        [(1, "a", 1, "running", START + 90 * day)],
        [(1, "a", 2, "completed", START)],  # 90 days late, and not dropped
        [(1, "a", 3, "running", START + day)],  # opens the second attempt
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        write_states(state_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    got = latest_states(spark, str(tmp_path / "out")).collect()
    assert sorted((r.activity_id, r.attempt, r.status, r.event_id) for r in got) == [("a", 1, "completed", 2), ("a#2", 2, "running", 3)]


def test_events_without_id_are_kept(spark):
    rows = [(1, "a", None, "running", START), (1, "a", None, "running", START), (1, "a", 5, "running", START), (1, "a", 5, "failed", START + dt.timedelta(1))]
    kept = ac.unique_events(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.event_id is None, r.status) for r in kept) == [(False, "running"), (True, "running"), (True, "running")]


def test_statistics(spark):
    rows = [("completed", 100, 2, 0), ("completed", 101, 0, 1), ("failed", 102, 1, 2), ("running", None, 0, 0)]
    frame = spark.createDataFrame(rows, "status string, duration_ms bigint, tool_count bigint, failed_activities bigint")
    assert tuple(ac.execution_stats(frame).first()) == (4, 2, 1, 3, 101, 50.0, 3, 1)
    assert tuple(ac.execution_stats(frame.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0, 0, 0)


def test_forwarding(spark):
    rows = [("r1", "search_web", "running"), ("r2", "x", "running"), (None, "generate_answer", "odd"), ("r1", "", "running"), ("r1", None, "failed")]
    frame = spark.createDataFrame(rows, "request_id string, action string, status string")
    got = [(r.stage, r.status) for r in ac.forwarded(frame, "r1").collect()]
    assert got == [("web_research", "running"), ("prepare_answer", "pending")]


def test_error_classes(spark):
    frame = spark.createDataFrame([("got 429 and 500",), ("INTERNAL",), ("Deadline",), ("other",), (None,)], "m string")
    found = frame.select(*[c.alias(n) for n, c in ac.classify_error(F.col("m")).items()]).collect()
    assert [tuple(r) for r in found] == [
        ("GEMINI_429", 429, True), ("GEMINI_500", 500, False), ("GEMINI_TIMEOUT", None, True),
        ("ANSWER_GENERATION_FAILED", None, False), ("ANSWER_GENERATION_FAILED", None, False),
    ]
