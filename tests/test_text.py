import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from saltmarsh.functions import questions as qs, text as tx, urls
from saltmarsh.operators import html
from saltmarsh.operators.ranking import understand

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def value(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


@SETTINGS
@given(st.lists(st.text(alphabet="ab \n\t\xa0é\U0001f600", max_size=60), min_size=1, max_size=8))
def test_chunks_are_stripped_slices(spark, texts):
    size, overlap = 10, 3
    got = value(spark, lambda t: tx.chunks(t, size, overlap), *texts)
    for text, pieces in zip(texts, got):
        want = [text[i : i + size].strip() for i in range(0, len(text), size - overlap)]
        assert pieces == [w for w in want if w]


@SETTINGS
@given(st.lists(st.text(alphabet="ab  \n\t\xa0 \x1c", max_size=40), min_size=1, max_size=8))
def test_squash_and_strip(spark, texts):
    assert value(spark, tx.squash, *texts) == [re.sub(r"\s+", " ", t).strip() for t in texts]
    assert value(spark, tx.strip, *texts) == [t.strip() for t in texts]


@SETTINGS
@given(st.lists(st.text(alphabet="abc ", max_size=70), min_size=1, max_size=8))
def test_article_windows_cover_the_text(spark, texts):
    size, overlap = 12, 4
    for text, windows in zip(texts, value(spark, lambda t: tx.article_windows(t, size, overlap), *texts)):
        starts, at = [], 0
        while at < len(text):
            starts.append(at)
            if at + size > len(text):
                break
            at += size - overlap
        want = [(n, text[s : s + size].strip()) for n, s in enumerate(starts)]
        assert [(w["chunk"], w["text"]) for w in windows] == [w for w in want if w[1]]


def test_marked_pages(spark):
    text = "intro===== PAGE 1 =====\n one \n\n\n\ntwo ===== PAGE 2 =====  \n===== PAGE 10 =====x"
    pages = value(spark, tx.marked_pages, text, "no marker", "")
    assert [(p["page"], p["text"]) for p in pages[0]] == [(1, "one \n\ntwo"), (10, "x")]
    assert pages[1:] == [[], []]


def test_paragraphs(spark):
    split = lambda t: tx.clean_paragraphs(F.split(t, "\\|"))
    assert value(spark, split, " a  b |Advertisement x|a b|| c|BACA JUGA: y", "") == ["a b\n\nc", ""]
    keep = lambda t: tx.distinct_paragraphs(F.split(t, "\\|"))
    assert value(spark, keep, "a|sponsored|a") == ["a\n\nsponsored"]


def test_answers(spark):
    text = "Hi\\nthere\n>>sources>> doc a\ndoc b <<\n***\nSources:\n\n\n\nend "
    assert value(spark, tx.clean_answer, text) == ["Hi\nthere\n\nend"]
    assert value(spark, tx.unwrap_answer, '{"answer": "yes"}', "plain", '{"x": 1}', "[1]") == ["yes", "plain", '{"x": 1}', "[1]"]


@pytest.mark.parametrize(
    "query,topic",
    [("Berita emas hari ini", "Emas"), ("latest NEWS", "General News"), (None, "General News"), ("harga o'brien 3rd-party, ", "Harga O'Brien 3Rd-Party")],
)
def test_topic_name(spark, query, topic):
    assert value(spark, tx.topic_name, query) == [topic]


def test_keys(spark):
    key = lambda u: urls.object_key(F.lit("Detail Finance!"), u)
    got = value(spark, key, "https://x.org/a/d-123/title", "https://x.org/d-77-title", "https://x.org/bad-12/")
    assert got[:2] == ["detail_finance/d-123.json", "detail_finance/d-77.json"]
    assert re.fullmatch("detail_finance/[0-9a-f]{64}.json", got[2])
    assert value(spark, urls.host, "HTTPS://User@WWW.X.org:80/p", "mailto:x") == ["www.x.org", None]
    assert value(spark, lambda u: urls.in_domain(u, "x.org"), "http://x.org", "http://a.x.org/", "http://ax.org", None) == [True, True, False, False]
    assert value(spark, urls.file_stem, "a/b.tar.gz", "a/.hidden", "plain") == ["b.tar", ".hidden", "plain"]
    assert value(spark, urls.content_type, "a/B.JSON", "x.bin") == ["application/json", "application/octet-stream"]


def test_session_keys(spark):
    rows = spark.createDataFrame([("https://x/d-5/t", "s1"), ("https://x/d-5/t", " "), ("https://x/d-5/t", None)], "u string, s string")
    day = F.lit("2024-03-09 23:00:00").cast("timestamp_ntz")
    keys = [r[0] for r in rows.select(urls.session_object_key(F.lit("Src"), F.col("u"), F.col("s"), day)).collect()]
    assert keys == ["computer_use/2024/03/09/s1/src/d-5.json", "src/d-5.json", "src/d-5.json"]


def test_understanding(spark):
    rows = spark.createDataFrame([("  Berita  Terbaru penjualan BCA di Q3 2024? ",), ("Why is the revenue forecast low",), ("apa itu",)], "text string")
    first, second, third = understand(rows).collect()
    assert first["normalized"] == "latest news sales bbca di q3 2024?"
    assert first["keywords"] == ["latest", "news", "sales", "bbca", "2024"]
    assert first["entities"] == ["q3", "2024"] and first["topics"] == ["news", "sales", "bbca"]
    assert (first["intent"], first["freshness"]) == ("NEWS", "recent")
    assert second["intent"] == "FORECAST" and second["freshness"] == "historical"
    assert second["expanded"] == "why is the revenue forecast low pendapatan omzet prediksi proyeksi"
    assert third["keywords"] == ["itu"] and third["intent"] == "INTERNAL_KNOWLEDGE"


def test_existing_synonym_is_replaced_again(spark):
    """A replaced word is looked for inside longer words as well."""
    assert value(spark, qs.normalise, "bbca") == ["bbbca"]


def test_search_variants(spark):
    got = value(spark, qs.search_variants, "kenapa Harga Emas?", "BI", "why is bitcoin prize down application context: x", "cuaca", "saham bbca")
    assert got[0] == ["Harga Emas", "emas Antam", "harga emas dunia", "logam mulia Indonesia"]
    assert got[1] == ["BI", "nilai tukar rupiah", "kebijakan Bank Indonesia", "kurs rupiah hari ini"]
    assert got[2] == ["bitcoin price down", "harga Bitcoin turun", "berita Bitcoin terbaru", "aset kripto Indonesia"]
    assert got[3] == ["cuaca", "berita cuaca", "ekonomi cuaca", "cuaca terbaru"]
    assert got[4] == ["saham bbca", "indeks saham Indonesia", "bursa saham Indonesia", "saham bbca hari ini"]


def test_flags(spark):
    rows = spark.createDataFrame([("why did gold price fall",), ("sales report",), ("hello",), ("forecast demand",)], "t string")
    flags = [tuple(r[0]) for r in rows.select(qs.routing_flags(F.col("t"))).collect()]
    assert flags == [(False, False, True, False), (True, False, False, True), (True, False, False, False), (False, True, False, False)]


def test_titles(spark):
    score = lambda t: qs.title_score(t, "harga silver naik")
    assert value(spark, score, "Harga Silver turun", "Harga beras", "Emas rally", "Gold rally", "Bank", None) == [2, None, 0, None, None, None]


PAGE = """<html><head><meta property="og:title" content="Meta"></head><body><nav><p>menu</p></nav>
<div class="ads"><p>buy</p></div><article><p>One &amp; two<p>One &amp; two</p><p class="x">Three<br>four</p><script>var a="<p>no</p>"</script>
<p>Advertisement</p></article><time>2024</time><span class="author">Ann</span></body></html>"""


def test_articles(spark):
    rows = [("http://x/1", PAGE), ("http://x/2", PAGE.replace("og:title", "none")), ("http://x/3", "<h1>T</h1><main> bare   text </main>"), ("http://x/4", "<h1>T</h1>")]
    got = {r["url"]: r for r in html.extract_articles(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert set(got) == {"http://x/1", "http://x/3"}
    first = got["http://x/1"]
    assert (first["title"], first["author"], first["published_at"], first["category"]) == ("Meta", "Ann", "2024", "Finance")
    assert first["content"] == "One & two\n\nThree four"
    assert got["http://x/3"]["content"] == "bare text"


def test_links(spark):
    page = '<a href="/a">Gold up</a><a href="#x">gold</a><a href="mailto:a">gold</a><a href="b?c">the gold</a><a href="//y.org/z">golden</a>'
    links = html.page_links(spark.createDataFrame([("https://x.org/d/e", page)], "url string, html string"))
    found = html.candidate_links(links, ["gold"]).orderBy("position").collect()
    assert [r["link"] for r in found] == ["https://x.org/a", "https://x.org/d/b?c"]


def test_routing_flags_of_a_long_line(spark):
    """One long line costs a time in proportion to its length; both words must stand in one line."""
    import time

    long = "some words without any meaning here " * 6000
    texts = [long, long + "gold price", "price of " + long + "\ngold", "a\r\ngold and " + long + " the price", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    start = time.perf_counter()
    found = frame.select("id", qs._line_has(F.col("text"), qs.FLAG_MARKET_NEWS).alias("moved")).orderBy("id").collect()
    assert [r.moved for r in found] == [False, True, False, True, None]
    assert frame.select(qs.routing_flags(F.col("text")).alias("f")).filter("f.news").count() >= 2
    assert time.perf_counter() - start < 20
