"""Activity events of request executions, in batch form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from saltmarsh.operators.rows import first_per_key

TERMINAL = ("completed", "failed")
CLOSING = ("completed", "failed", "skipped")
STATUSES = ("running", "completed", "failed", "skipped")

# Actions shown under another stage name.
STAGE_NAMES = {"generate_answer": "prepare_answer", "search_web": "web_research"}

# Error classes by message text; the first match counts.
ERROR_CLASSES = (
    ("429|RESOURCE_EXHAUSTED", "GEMINI_429", 429, True),
    ("503|UNAVAILABLE", "GEMINI_503", 503, True),
    ("500|INTERNAL", "GEMINI_500", 500, False),
    ("(?i)deadline|timeout", "GEMINI_TIMEOUT", None, True),
)
OTHER_ERROR = "ANSWER_GENERATION_FAILED"

RETAINED = 100


def unique_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """First delivery of every event; events without an id are all kept."""
    named = first_per_key(events.filter(F.col(key).isNotNull()), [key], [F.col("ts")])
    return named.unionByName(events.filter(F.col(key).isNull()))


def stage_of(action: Column) -> Column:
    renamed = action
    for name, stage in STAGE_NAMES.items():
        renamed = F.when(action == name, stage).otherwise(renamed)
    return renamed


def status_of(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status).otherwise("pending")


def forwarded(events: DataFrame, request: object | None = None, request_column: str = "request_id") -> DataFrame:
    """Events as shown to a client: other requests and empty stages out, names and statuses mapped."""
    rows = events
    if request is not None:
        rows = rows.filter(F.col(request_column).isNull() | (F.col(request_column) == F.lit(request)))
    shown = rows.withColumns({"stage": stage_of(F.coalesce("action", F.lit(""))), "status": status_of(F.col("status"))})
    return shown.filter(F.col("stage") != "")


def number_attempts(events: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Attempt number of every event: a running event after a terminal one opens the next attempt.

    ``events`` has execution_id, activity_id, event_id, status, ts. The history
    of an activity is cut into time slices that are ordered independently; one
    summary row per slice carries the state across. So one activity with a large
    share of all events is still handled by many tasks. Every event needs an
    execution, an activity and a time.
    """
    moves = F.col("status").isin("running", *TERMINAL)
    keys = ("execution_id", "activity_id", "_slice")
    inside = W.partitionBy(*keys).orderBy("ts", "event_id")
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    running = F.col("status") == "running"
    sliced = events.withColumn("_slice", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (slice_seconds * 1_000_000)))
    # The join below implies these tests; stated here they make both of its sides
    # read the same shuffle of the events.
    placed = sliced.filter(" AND ".join(f"{key} IS NOT NULL" for key in keys))
    rows = placed.withColumn("_previous", F.last(F.when(moves, F.col("status")), ignorenulls=True).over(earlier))
    rows = rows.withColumn("_opens", F.coalesce(running & F.col("_previous").isin(*TERMINAL), F.lit(False)).cast("int"))

    place = F.struct("ts", "event_id")
    summary = rows.groupBy(*keys).agg(
        F.sum("_opens").alias("known"),
        F.min(F.when(moves, F.struct(place.alias("p"), F.col("status").alias("s"))))["s"].alias("first_move"),
        F.max(F.when(moves, F.struct(place.alias("p"), F.col("status").alias("s"))))["s"].alias("last_move"),
    )
    before = W.partitionBy("execution_id", "activity_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.withColumn("_incoming", F.last("last_move", ignorenulls=True).over(before))
    boundary = F.coalesce((F.col("first_move") == "running") & F.col("_incoming").isin(*TERMINAL), F.lit(False)).cast("int")
    carried = carried.withColumn("_base", F.coalesce(F.sum(F.col("known") + boundary).over(before), F.lit(0)))

    joined = rows.join(carried.select(*keys, "_incoming", "_base"), list(keys))
    at_boundary = running & F.col("_previous").isNull() & F.coalesce(F.col("_incoming").isin(*TERMINAL), F.lit(False))
    opened = F.sum(F.col("_opens") + at_boundary.cast("int")).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn("attempt", (1 + F.col("_base") + opened).cast("int")).select(*events.columns, "attempt")


def activity_states(events: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Final state of every attempt of every activity.

    The latest event decides until the attempt is terminal; after that only events
    of the same terminal status count.
    """
    numbered = number_attempts(events, slice_seconds)
    place = F.struct("ts", "event_id", "status")
    status = F.col("status")
    last_of = lambda name: F.max(F.when(status == name, F.struct("ts", "event_id")))
    grouped = numbered.groupBy("execution_id", "activity_id", "attempt").agg(
        F.min("ts").alias("started_at"),
        F.min(F.when(status.isin(*TERMINAL), place)).alias("_end"),
        F.max(place).alias("_last"),
        last_of("completed").alias("_completed"),
        last_of("failed").alias("_failed"),
    )
    end = F.col("_end.status")
    final = F.when(end == "completed", F.col("_completed")).when(end == "failed", F.col("_failed"))
    state = F.coalesce(end, F.col("_last.status"))
    seen = F.coalesce(final["ts"], F.col("_last.ts"))
    base = F.col("activity_id").cast("string")
    return grouped.select(
        "execution_id",
        F.when(F.col("attempt") > 1, F.concat_ws("#", base, F.col("attempt").cast("string"))).otherwise(base).alias("activity_id"),
        "attempt",
        state.alias("status"),
        "started_at",
        F.when(state.isin(*CLOSING), seen).alias("completed_at"),
        seen.alias("updated_at"),
        F.coalesce(final["event_id"], F.col("_last.event_id")).alias("event_id"),
    )


def close_executions(events: DataFrame) -> DataFrame:
    """Status, start, end and duration of every execution from its first and last event."""
    return closed(execution_ends(events))


def execution_ends(events: DataFrame) -> DataFrame:
    place = F.struct("ts", "event_id", "status")
    return events.groupBy("execution_id").agg(F.min("ts").alias("started_at"), F.max(place).alias("_last"))


def closed(ends: DataFrame) -> DataFrame:
    state = F.when(F.col("_last.status").isin(*TERMINAL), F.col("_last.status")).otherwise("running")
    done = F.when(F.col("_last.status").isin(*TERMINAL), F.col("_last.ts"))
    millis = F.floor(
        (F.unix_micros(done.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000
    )
    return ends.select("execution_id", "started_at", done.alias("completed_at"), millis.alias("duration_ms"), state.alias("status"))


def retained(executions: DataFrame, limit: int = RETAINED) -> DataFrame:
    """The most recently started executions."""
    return executions.orderBy(F.desc("started_at"), F.desc("execution_id")).limit(limit)


def execution_stats(executions: DataFrame) -> DataFrame:
    """One row of statistics. Needs status, duration_ms, tool_count, failed_activities."""
    count_of = lambda name: F.count_if(F.col("status") == name)
    total = F.count(F.lit(1))
    return executions.agg(
        total.alias("total_sessions"),
        count_of("completed").alias("successful_sessions"),
        count_of("failed").alias("failed_sessions"),
        F.coalesce(F.sum("tool_count"), F.lit(0)).alias("tools_used"),
        F.coalesce(F.bround(F.avg("duration_ms"), 0).cast("bigint"), F.lit(0)).alias("average_response_time_ms"),
        F.when(total > 0, F.round(count_of("completed") / total * 100, 1)).otherwise(0.0).alias("success_rate"),
        F.coalesce(F.sum("failed_activities"), F.lit(0)).alias("error_count"),
        count_of("running").alias("active_executions"),
    )


def tools_per_execution(events: DataFrame, tool: str = "tool") -> DataFrame:
    """Number of different tools per execution; repeated uses are combined on the map side."""
    pairs = events.filter(F.col(tool).isNotNull()).select("execution_id", tool).distinct()
    return pairs.groupBy("execution_id").agg(F.count(F.lit(1)).alias("tool_count"))


def failed_activities(states: DataFrame) -> DataFrame:
    return states.groupBy("execution_id").agg(F.count_if(F.col("status") == "failed").alias("failed_activities"))


def executions(events: DataFrame, tool: str = "tool") -> DataFrame:
    """Closed executions with their tool and failure counts."""
    return (
        close_executions(events)
        .join(tools_per_execution(events, tool), "execution_id", "left")
        .join(failed_activities(activity_states(events)), "execution_id", "left")
        .na.fill(0, ["tool_count", "failed_activities"])
    )


def classify_error(message: Column) -> dict[str, Column]:
    code: Column = F.lit(OTHER_ERROR)
    retry: Column = F.lit(False)
    http: Column = F.lit(None).cast("int")
    for pattern, name, number, again in reversed(ERROR_CLASSES):
        hit = F.coalesce(message.rlike(pattern), F.lit(False))
        code = F.when(hit, name).otherwise(code)
        retry = F.when(hit, F.lit(again)).otherwise(retry)
        http = F.when(hit, F.lit(number).cast("int")).otherwise(http)
    return {"code": code, "http_status": http, "retryable": retry}


def map_statuses(column: Column, table: Mapping[str, str], default: str = "pending") -> Column:
    pairs = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.coalesce(pairs[column], F.lit(default))
