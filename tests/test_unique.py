"""De-duplication of a stream with a store of ids."""

import datetime as dt
import os

from saltmarsh.streaming import unique

SCHEMA = "event_id bigint, ts timestamp_ntz, kind string"
START = dt.datetime(2024, 1, 1)


def deliver(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    unique.write_unique(stream, str(tmp_path / "out"), str(tmp_path / "check"))


def test_late_copies_of_any_age_are_found(spark, tmp_path):
    day = dt.timedelta(days=1)
    first = [(i, START + i * day, "first") for i in range(300)] + [(None, START, "no id")]
    deliver(spark, tmp_path, first + first[:50])
    deliver(spark, tmp_path, [(i, START + 900 * day, "second") for i in range(250, 400)] + [(None, START, "no id")])
    deliver(spark, tmp_path, [(i, START + 990 * day, "late copy") for i in range(0, 400, 3)] + [(1000, START, "third")])
    rows = unique.unique_events(spark, str(tmp_path / "out")).collect()
    named = {r.event_id: r.kind for r in rows if r.event_id is not None}
    assert len(rows) == 401 + 2 and sum(r.event_id is None for r in rows) == 2
    assert named == {i: "first" for i in range(300)} | {i: "second" for i in range(300, 400)} | {1000: "third"}
    assert not os.path.exists(tmp_path / "check" / "state")  # nothing grows in memory


def test_a_repeated_trigger_writes_the_same(spark, tmp_path):
    deliver(spark, tmp_path, [(1, START, "a"), (2, START, "a")])
    deliver(spark, tmp_path, [(2, START, "b"), (3, START, "b")])
    # The commit of the last trigger is lost, so it runs once more.
    os.remove(tmp_path / "check" / "commits" / "1")
    crc = tmp_path / "check" / "commits" / ".1.crc"
    if crc.exists():
        os.remove(crc)
    deliver(spark, tmp_path, [(1, START, "c"), (4, START, "c")])
    rows = sorted((r.event_id, r.kind) for r in unique.unique_events(spark, str(tmp_path / "out")).collect())
    assert rows == [(1, "a"), (2, "a"), (3, "b"), (4, "c")]


def test_filters_miss_no_id():
    import numpy as np
    import pandas as pd

    draw = np.random.default_rng(1)
    ids = draw.integers(-(2**62), 2**62, (2, 5000))
    frame = pd.DataFrame({"bucket": 3, "id": np.arange(5000), "one": ids[0], "two": ids[1]})
    made = unique._filter_of(frame.iloc[:2500])
    seen = set(unique._maybe_seen(frame, made)["id"])
    assert seen >= set(range(2500)) and len(seen) < 2500 + 75
