"""Resolution of not-modified revisits in web archives.

A revisit record says that a server answered "not modified". Its content is that
of the latest earlier full response of the same canonical url, if the validators
agree: entity tags by weak comparison, or, where either side has none, the
last-modified dates. The resolved record has the payload and the headers of the
response; the header fields that a not-modified answer may update come from the
revisit.

The as-of join never brings a whole url together: the latest response inside a
slice of time is found per (url, slice), and slices hand on one row each. Bodies
move once, by the id of the response; a response that many revisits ask for goes
to several groups.

Revisits without a url or date, or without an earlier response, have the outcome
"no earlier response"; of records at one instant, responses come first, then ids
decide. Repeated rows resolve alike. Columns other than those named are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from saltmarsh.operators.rows import materialise

# Header fields that a not-modified response updates.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Fixed value: query parameters that name no resource.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid)(=|$)"
SLICE_SECONDS = 3600
# Revisits of one response that are handled together.
GROUP_ROWS = 20_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without trailing slashes, sorted parameters.

    Scheme, fragment and tracking parameters do not count.
    """
    bare = F.regexp_replace(F.regexp_replace(F.btrim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^[^/?]*", ""), r"(?s)[?].*$", ""), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(TRACKING))))
    joined = F.array_join(kept, "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


def first_header(fields: Column, name: str) -> Column:
    """A header field whatever the case of its name; null when there is none."""
    found = F.map_values(F.map_filter(fields, lambda k, _: F.lower(k) == name))
    return F.get(found, F.lit(0))


def validators_agree(left: dict[str, Column], right: dict[str, Column]) -> Column:
    def strong(tag: Column) -> Column:
        return F.regexp_replace(F.btrim(tag), "^W/", "")

    tags = left["etag"].isNotNull() & right["etag"].isNotNull()
    return F.coalesce(F.when(tags, strong(left["etag"]) == strong(right["etag"])).otherwise(left["modified"] == right["modified"]), F.lit(False))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored fields, replaced by fresh ones where these are permitted; names in lower case."""

    def entries(fields: Column) -> Column:
        lowered = F.transform(F.map_entries(fields), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        return F.coalesce(lowered, F.array().cast("array<struct<key:string,value:string>>"))

    updates = F.filter(entries(fresh), lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(updates, lambda e: e["key"])
    kept = F.filter(entries(stored), lambda e: ~F.array_contains(names, e["key"]))
    everything = F.array_sort(F.concat(kept, updates))
    # Of fields whose names differ in case only, the least value counts.
    first = F.filter(
        F.transform(everything, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: (e["i"] == 0) | (F.get(everything, e["i"] - 1)["key"] != e["key"]),
    )
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"])))


def latest_response(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(record_id, source_id): the latest response before every revisit of its url."""
    # Responses precede revisits of the same instant.
    order = F.struct(F.col("date"), F.col("warc_type"), F.col("record_id"))
    timed = records.filter(F.col("url").isNotNull() & F.col("date").isNotNull())
    timed = timed.select("record_id", "url", "warc_type", order.alias("at"), F.floor(F.unix_micros("date") / (slice_seconds * 1_000_000)).alias("slice"))
    timed = materialise(timed, "captures")
    response = F.when(F.col("warc_type") == "response", F.col("at"))
    slices = timed.groupBy("url", "slice").agg(F.max(response).alias("last"))
    earlier = W.partitionBy("url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    handed = slices.select("url", "slice", F.last("last", ignorenulls=True).over(earlier).alias("handed"))
    handed = materialise(handed, "slices")
    inside = W.partitionBy("url", "slice").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    near = timed.select("record_id", "url", "slice", "warc_type", F.last(response, ignorenulls=True).over(inside).alias("near"))
    near = near.filter(F.col("warc_type") == "revisit").join(handed, ["url", "slice"])
    return near.select("record_id", F.coalesce("near", "handed")["record_id"].alias("source_id")).dropDuplicates(["record_id"])


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every revisit with canonical_url, outcome, source_id, and payload and headers if resolved.

    ``records`` has record_id, warc_type ("response", "revisit", ...), target_uri,
    date (timestamp), headers (map of strings) and payload.
    """
    known = records.withColumn("url", canonical_url(F.col("target_uri")))
    sources = latest_response(known.filter(F.col("warc_type").isin("response", "revisit")), slice_seconds)
    revisits = known.filter(F.col("warc_type") == "revisit").select("record_id", "url", "headers").join(sources, "record_id", "left")
    revisits = materialise(revisits, "revisits")
    asked = revisits.filter(F.col("source_id").isNotNull())
    # A response that very many revisits ask for is copied into several groups; there are few of these.
    crowd = asked.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("revisits"))
    crowd = crowd.filter(F.col("revisits") > group_rows).select("id", F.ceil(F.col("revisits") / group_rows).cast("int").alias("groups"))
    crowd = materialise(crowd, "crowd")
    groups = F.coalesce("groups", F.lit(1))
    responses = known.filter((F.col("warc_type") == "response") & F.col("record_id").isNotNull()).select(
        F.col("record_id").alias("id"), F.lit(0).alias("turn"), F.col("headers").alias("stored"), "payload"
    )
    responses = responses.join(crowd, "id", "left").withColumn("group", F.explode(F.sequence(F.lit(0), groups - 1))).drop("groups")
    waiting = asked.withColumnRenamed("source_id", "id").join(crowd, "id", "left").withColumn("turn", F.lit(1))
    waiting = waiting.withColumn("group", F.pmod(F.xxhash64("record_id"), groups).cast("int")).drop("groups")
    # One shuffle brings a response and its revisits together; the response is the first of its group.
    together = responses.unionByName(waiting, allowMissingColumns=True)
    group = W.partitionBy("id", "group").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    given = together.withColumns({c: F.first(c).over(group) for c in ("stored", "payload")}).filter("turn = 1")
    given = given.withColumn("response_id", F.col("id")).select("record_id", "url", "headers", "response_id", "stored", "payload")
    joined = given.unionByName(revisits.filter(F.col("source_id").isNull()).drop("source_id"), allowMissingColumns=True)

    def validators(fields: Column) -> dict[str, Column]:
        return {"etag": first_header(fields, "etag"), "modified": first_header(fields, "last-modified")}

    agree = validators_agree(validators(F.col("headers")), validators(F.col("stored")))
    joined = joined.withColumn("agree", F.col("response_id").isNotNull() & agree)
    outcome = F.when(F.col("response_id").isNull(), "no earlier response").when(F.col("agree"), "resolved").otherwise("validator differs")
    return joined.select(
        "record_id",
        F.col("url").alias("canonical_url"),
        outcome.alias("outcome"),
        F.when(F.col("agree"), F.col("response_id")).alias("source_id"),
        F.when(F.col("agree"), F.col("payload")).alias("payload"),
        F.when(F.col("agree"), merged_headers(F.col("stored"), F.col("headers"))).alias("headers"),
    )
