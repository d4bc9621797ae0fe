"""Revisits resolve to the latest earlier response with agreeing validators."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from saltmarsh.llm import warc

SCHEMA = "record_id long, warc_type string, target_uri string, date timestamp, headers map<string,string>, payload string, url string, agree int"


def at(minute):
    return datetime(2024, 1, 1, minute // 60, minute % 60, tzinfo=timezone.utc)


def test_resolution(spark):
    rows = [
        (1, "response", "https://Example.com/a/?b=2&a=1#x", at(0), {"ETag": '"1"', "Content-Type": "text/html", "Expires": "old"}, "first"),
        (2, "response", "http://www.example.com:80/a?a=1&b=2&utm_source=z", at(100), {"etag": '"2"'}, "second"),
        (3, "revisit", "http://example.com/a?a=1&b=2", at(50), {"etag": 'W/"1"', "expires": "new", "content-type": "no"}, None),
        (4, "revisit", "http://example.com/a?a=1&b=2", at(100), {"ETAG": '"2"'}, None),  # the response of that instant
        (5, "revisit", "http://example.com/a?a=1&b=2", at(900), {"etag": '"1"'}, None),  # the latest has another tag
        (6, "revisit", "http://example.com/none", at(10), {"etag": '"1"'}, None),
        (7, "response", "http://m.org/d", at(0), {"Last-Modified": "Mon"}, "dated"),
        (8, "revisit", "http://m.org/d/", at(600), {"last-modified": "Mon"}, None),
        (9, "revisit", "http://m.org/d/", at(601), None, None),
        (10, "revisit", None, at(601), {"etag": "x"}, None),
        (11, "revisit", "http://m.org/d", None, {"last-modified": "Mon"}, None),
        (12, "request", "http://m.org/d", at(1), {"last-modified": "Mon"}, "no"),
        (8, "revisit", "http://m.org/d/", at(600), {"last-modified": "Mon"}, None),  # repeated
        (13, "response", "http://n.org/", at(5), {"etag": "a"}, None),
        (13, "response", "http://n.org/", at(5), {"etag": "a"}, None),  # repeated
        (14, "revisit", "http://n.org", at(6), {"etag": "a"}, None),
        (None, None, None, None, None, None),
    ]
    records = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = warc.resolve_revisits(records).collect()
    assert len(found) == 10
    by = {r.record_id: r for r in found}
    assert {i: (r.outcome, r.source_id, r.payload) for i, r in by.items()} == {
        3: ("resolved", 1, "first"),
        4: ("resolved", 2, "second"),
        5: ("validator differs", None, None),
        6: ("no earlier response", None, None),
        8: ("resolved", 7, "dated"),
        9: ("validator differs", None, None),
        10: ("no earlier response", None, None),
        11: ("no earlier response", None, None),
        14: ("resolved", 13, None),
    }
    assert by[3].headers == {"etag": 'W/"1"', "content-type": "text/html", "expires": "new"}
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_canonical_url(spark):
    urls = ["HTTP://WWW.Ex.org:443/p//?", "ex.org/p#f?x", "https://ex.org/p/?utm_medium=1&gclid=2", "", None]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.c for r in frame.select(warc.canonical_url(F.col("u")).alias("c")).collect()] == ["ex.org/p", "ex.org/p", "ex.org/p", "", None]


def test_many_revisits_of_one_response(spark):
    rows = [(0, "response", "http://a.org", at(0), {"etag": "1"}, "body")] + [(n, "revisit", "http://a.org", at(n), {"etag": "1"}, None) for n in range(1, 200)]
    records = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = warc.resolve_revisits(records, group_rows=7).collect()
    assert sorted((r.record_id, r.source_id, r.payload) for r in found) == [(n, 0, "body") for n in range(1, 200)]
