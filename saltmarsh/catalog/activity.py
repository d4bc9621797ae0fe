"""Activity events: users as executions, the number in the properties as activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.operators import activity as op

BOOK = Book()

STATUS = {"view": "running", "click": "running", "signup": "running", "purchase": "completed", "error": "failed"}
_CASE = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END"
E = f"""e AS (SELECT user_id AS execution_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS activity_id, event_id, ts, event_type AS tool, {_CASE} AS status FROM events)"""


def activity_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("execution_id"),
        F.get_json_object("props", "$.k").cast("int").alias("activity_id"),
        "event_id",
        "ts",
        F.col("event_type").alias("tool"),
        op.map_statuses(F.col("event_type"), STATUS).alias("status"),
    )


_ATTEMPTS = f"""WITH {E}, p AS (SELECT *, lag(status) OVER (PARTITION BY execution_id, activity_id ORDER BY ts, event_id) AS prev FROM e),
  n AS (SELECT *, 1 + sum(CASE WHEN status = 'running' AND prev IN ('completed', 'failed') THEN 1 ELSE 0 END)
          OVER (PARTITION BY execution_id, activity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS attempt FROM p)"""

_STATES = _ATTEMPTS + """, f AS (SELECT execution_id, activity_id, attempt, min(ts) AS started_at, arg_min(status, (ts, event_id)) FILTER (status <> 'running') AS final,
    arg_max(status, (ts, event_id)) AS last_status, max(ts) AS last_ts, arg_max(event_id, (ts, event_id)) AS last_event FROM n GROUP BY 1, 2, 3),
  g AS (SELECT f.*, max(n.ts) AS end_ts, arg_max(n.event_id, (n.ts, n.event_id)) AS end_event FROM f LEFT JOIN n ON n.execution_id = f.execution_id AND n.activity_id = f.activity_id
        AND n.attempt = f.attempt AND n.status = f.final GROUP BY ALL),
  states AS (SELECT execution_id, activity_id || CASE WHEN attempt > 1 THEN '#' || attempt ELSE '' END AS activity_id, CAST(attempt AS INTEGER) AS attempt, coalesce(final, last_status) AS status,
    started_at, end_ts AS completed_at, coalesce(end_ts, last_ts) AS updated_at, coalesce(end_event, last_event) AS event_id FROM g)"""


@BOOK.add(
    "x01_unique_events",
    "SELECT event_id, min(ts) AS ts, count(*) AS copies FROM events GROUP BY 1",
)
def _unique(t: Tables) -> DataFrame:
    """Every event delivered twice, the second time a minute later."""
    late = t.events.withColumn("ts", F.timestamp_add("MINUTE", F.lit(1), F.col("ts")))
    kept = op.unique_events(t.events.unionByName(late))
    return kept.groupBy("event_id").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("copies"))


@BOOK.add("x02_numbered_attempts", _ATTEMPTS + " SELECT event_id, CAST(attempt AS INTEGER) AS attempt FROM n")
def _attempts(t: Tables) -> DataFrame:
    return op.number_attempts(activity_events(t.events), slice_seconds=86400).select("event_id", "attempt")


@BOOK.add("x02_activity_states", _STATES + " SELECT * FROM states")
def _states(t: Tables) -> DataFrame:
    return op.activity_states(activity_events(t.events), slice_seconds=86400)


# Fewer activities per execution, so that attempts repeat and slices matter.
_COARSE = _STATES.replace("CAST(json_extract_string(props, '$.k') AS INTEGER)", "CAST(json_extract_string(props, '$.k') AS INTEGER) % 3")


@BOOK.add("x02_busy_activity_states", _COARSE + " SELECT * FROM states")
def _busy(t: Tables) -> DataFrame:
    return op.activity_states(activity_events(t.events).withColumn("activity_id", F.col("activity_id") % 3))


_CLOSED = f"""WITH {E}, c AS (SELECT execution_id, min(ts) AS started_at, max(ts) AS last_ts, arg_max(status, (ts, event_id)) AS status FROM e GROUP BY 1),
  x AS (SELECT execution_id, started_at, CASE WHEN status <> 'running' THEN last_ts END AS completed_at,
    CASE WHEN status <> 'running' THEN CAST(floor((epoch_us(last_ts) - epoch_us(started_at)) / 1000) AS BIGINT) END AS duration_ms, status FROM c)"""


@BOOK.add("x03_closed_executions", _CLOSED + " SELECT * FROM x")
def _closed(t: Tables) -> DataFrame:
    return op.close_executions(activity_events(t.events))


@BOOK.add("x04_retained_executions", _CLOSED + " SELECT * FROM x ORDER BY started_at DESC, execution_id DESC LIMIT 100")
def _retained(t: Tables) -> DataFrame:
    return op.retained(op.close_executions(activity_events(t.events)))


@BOOK.add(
    "x05_forwarded_events",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'prepare_answer' WHEN 'click' THEN 'web_research' ELSE event_type END AS stage,
              CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'skipped' ELSE 'pending' END AS status
       FROM events WHERE event_type <> 'signup' AND (event_type = 'error' OR user_id = (SELECT max(user_id) FROM events))""",
)
def _forwarded(t: Tables) -> DataFrame:
    """One request's events plus those that name no request."""
    kind = F.col("event_type")
    wanted = t.events.agg(F.max("user_id").alias("u")).first()["u"]
    rows = t.events.select(
        "event_id",
        F.when(kind != "error", F.col("user_id")).alias("request_id"),
        F.when(kind == "view", "generate_answer").when(kind == "click", "search_web").when(kind == "signup", "").otherwise(kind).alias("action"),
        F.when(kind == "view", "running").when(kind == "click", "skipped").otherwise("queued").alias("status"),
    )
    return op.forwarded(rows, wanted).select("event_id", "stage", "status")


@BOOK.add(
    "a16_execution_statistics",
    _STATES
    + """, c AS (SELECT execution_id, min(ts) AS s, max(ts) AS l, arg_max(status, (ts, event_id)) AS status, count(DISTINCT tool) AS tools FROM e GROUP BY 1),
  d AS (SELECT *, CASE WHEN status <> 'running' THEN floor((epoch_us(l) - epoch_us(s)) / 1000) END AS ms FROM c)
SELECT count(*) AS total_sessions, count(*) FILTER (status = 'completed') AS successful_sessions, count(*) FILTER (status = 'failed') AS failed_sessions,
  CAST(sum(tools) AS BIGINT) AS tools_used, CAST(round_even(avg(ms), 0) AS BIGINT) AS average_response_time_ms,
  round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 1) AS success_rate, (SELECT count(*) FROM states WHERE status = 'failed') AS error_count,
  count(*) FILTER (status = 'running') AS active_executions FROM d""",
)
def _statistics(t: Tables) -> DataFrame:
    return op.execution_stats(op.executions(activity_events(t.events)))
