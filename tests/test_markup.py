"""Nested boxes, unclosed elements, scripts and bodies by role."""

import pytest

from saltmarsh.operators import markup


@pytest.mark.parametrize(
    "page,wanted",
    [
        ("a<nav>x<nav>y</nav>z</nav>b", "a b"),
        ('a<div class="Related"><div>1</div><div><div>2</div></div>3</div>b</div>c', "a b</div>c"),
        ('<div id="advert-1">x</div><div id="share">kept</div>', ' <div id="share">kept</div>'),
        ("<section class='my ads'>x</section>b", " b"),
        ('<div class="badge">kept</div>', '<div class="badge">kept</div>'),
        ('a<img class="banner" src="x">b', "a b"),
        ("a<!-- <nav> -->b<!-- open", "a b "),
        ("a<script>if (a<b) '</div><nav>'</script>b<style>p{}</style>c", "a b c"),
        ("a<aside><p>never closed", "a "),
        ("a</nav>b<form>x</form >c", "a</nav>b c"),
        ("1 < 2 and <b>3</b>", "1 < 2 and <b>3</b>"),
        ("", ""),
    ],
)
def test_without_noise(page, wanted):
    assert markup.without_noise(page) == wanted


@pytest.mark.parametrize(
    "page,paragraphs,body",
    [
        ("<p>out</p><article><p>a<p>b<br>c</p>d<article><p>e</p></article><p>f</p></article><p>out</p>", ["a", "b c", "e", "f"], "ab cdef"),
        ("<main><p>m</p></main><article><p>a</p></article>", ["a", "m"], "a"),
        ("<main><article><p>both</p></article><p>main</p></main>", ["both", "both", "main"], "both"),
        ("<div role='main'><div><p>in</p></div><p>in too</div><p>out</p>", ["in", "in too"], "inin too"),
        ("<article>no paragraph<script>var p='<p>no</p>'</script> at all</article>", [], "no paragraph at all"),
        ("<article> </article><main> text </main>", [], " text "),
        ("<article><p>open <noscript><p>unseen</p></noscript>end", ["open end"], "open end"),
        ("<pre>x</pre><article><param><p>1</p></article>", ["1"], "1"),
        ("", [], None),
    ],
)
def test_bodies(page, paragraphs, body):
    assert markup.bodies(page) == (paragraphs, body)


def test_columns(spark):
    frame = spark.createDataFrame([(1, "a<nav>x</nav><article><p>t</p></article>"), (2, None)], "i int, html string")
    rows = frame.select("i", markup.remove_noise("html").alias("clean"), markup.page_bodies("html").alias("b")).orderBy("i").collect()
    assert (rows[0].clean, rows[0].b.paragraphs, rows[0].b.body) == ("a <article><p>t</p></article>", ["t"], "t")
    assert (rows[1].clean, rows[1].b.paragraphs, rows[1].b.body) == (None, [], None)


def test_many_boxes_take_linear_time():
    import time

    page = "<div class='related'>" + "<div>" * 40_000 + "</div>" * 40_000 + "</div>end<article>" + "<p>x" * 40_000
    start = time.perf_counter()
    assert markup.without_noise(page).startswith(" end") and len(markup.bodies(page)[0]) == 40_000
    assert time.perf_counter() - start < 5
