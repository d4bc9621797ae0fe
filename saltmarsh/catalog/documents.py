"""Page extraction, evidence records, paging and identity over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.catalog.texts import sql_squash
from saltmarsh.functions import urls
from saltmarsh.operators import evidence as ev, html, markup, paging
from saltmarsh.operators.rows import first_per_key, materialise
from saltmarsh.scratch import run_folder

BOOK = Book()


def _sql_decode(column: str) -> str:
    """The character entities that occur in the pages, ampersand last."""
    out = column
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


def _sql_plain(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '(?i)<br\\s*/?>', ' ', 'g'), '(?s)<[^>]*>', '', 'g')"


SQL_TITLE = sql_squash(_sql_plain("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)"))

def sql_articles(html_column: str = "html") -> str:
    """Articles by tags in a row with running counts: depth of each body kind, number and end of each p."""
    kinds = {"a": "name = 'article'", "m": "name = 'main'"}
    depths = ", ".join(
        f"sum(CASE WHEN {rule} THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER w AS depth_{k}" for k, rule in kinds.items()
    )
    return f"""
shown AS (SELECT page_id, url, html AS raw, regexp_replace(regexp_replace({html_column}, '(?s)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>|<style.*?</style>', '', 'g') AS html FROM pages),
tags AS (SELECT page_id, u.i, lower(regexp_extract(u.tok, '^</?([a-zA-Z0-9]+)', 1)) AS name, u.tok LIKE '</%' AS closing,
    regexp_matches(u.tok, '^<[^>]*role=["'']main') AS main_role, regexp_extract(u.tok, '>([^<]*)$', 1) AS txt
  FROM shown, unnest(regexp_extract_all(html, '<[^>]*>[^<]*')) WITH ORDINALITY AS u(tok, i)),
role AS (SELECT page_id, min(i) AS r0, arg_min(name, i) AS rname FROM tags WHERE main_role GROUP BY 1),
bal AS (SELECT t.page_id, i, r0, sum(CASE WHEN name <> rname THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY t.page_id ORDER BY i) AS open_
  FROM tags t JOIN role r ON t.page_id = r.page_id WHERE i >= r0),
reach AS (SELECT page_id, any_value(r0) AS r0, coalesce(min(i) FILTER (open_ = 0), 1000000000) AS r1 FROM bal GROUP BY 1),
counted AS (SELECT t.*, {depths}, CASE WHEN i >= r0 AND i < r1 THEN 1 ELSE 0 END AS depth_r, coalesce(i IN (r0, r1), false) AS role_edge,
    sum(CASE WHEN name = 'p' AND NOT closing THEN 1 ELSE 0 END) OVER w AS pno FROM tags t LEFT JOIN reach r ON t.page_id = r.page_id
  WINDOW w AS (PARTITION BY t.page_id ORDER BY i)),
pieces AS (SELECT *, sum(CASE WHEN (name = 'p' AND closing) OR name IN ('article', 'main') OR role_edge THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, pno ORDER BY i) AS ended
  FROM counted WHERE pno > 0),
whole AS (SELECT page_id, pno, string_agg(CASE WHEN name = 'br' THEN ' ' || txt ELSE txt END, '' ORDER BY i) FILTER (ended = 0) AS raw,
    arg_min(depth_a, i) AS da, arg_min(depth_m, i) AS dm, arg_min(depth_r, i) AS dr FROM pieces GROUP BY 1, 2),
paras AS (SELECT page_id, pno, k, {sql_squash('raw')} AS p FROM whole, (VALUES (1), (2), (3)) kinds(k)
  WHERE CASE k WHEN 1 THEN da WHEN 2 THEN dm ELSE dr END > 0),
uniq AS (SELECT page_id, p, min(k * 1000000 + pno) AS i FROM paras WHERE p <> '' AND NOT (contains(lower(p), 'baca juga:') OR contains(lower(p), 'advertisement')
  OR contains(lower(p), 'sponsored') OR contains(lower(p), 'ikuti kami')) GROUP BY 1, 2),
texts AS (SELECT page_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS content FROM uniq GROUP BY 1),
firsts AS (SELECT page_id, url, {SQL_TITLE.replace('html', 'raw')} AS title, {sql_squash(_sql_plain("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"))} AS body FROM shown),
articles AS (SELECT b.page_id, b.url, {_sql_decode('b.title')} AS title, 'Finance' AS category, CAST(NULL AS VARCHAR) AS author,
   CAST(NULL AS VARCHAR) AS published_at, {_sql_decode("coalesce(t.content, b.body)")} AS content
  FROM firsts b LEFT JOIN texts t USING (page_id) WHERE b.title <> '' AND coalesce(t.content, b.body) <> '')
"""


SQL_ARTICLES = sql_articles()

# Shapes that the given pages lack: text of a main element around the article, a second article
# with a nested box, a page whose body is known by its role alone.
_RESHAPED = """CASE page_id % 4
  WHEN 0 THEN replace(html, '<article>', '<main class=''x''><p>Before page ' || page_id || '</p><article>') || '<p>After</p></main><p>Outside</p>'
  WHEN 1 THEN html || '<article><p>Second of ' || page_id || '<div class="related"><div><p>Inner box</div><p>After inner</p></div></article><p>Outside</p>'
  WHEN 2 THEN replace(replace(html, '<article>', '<div role=''main''>'), '</article>', '</div>')
  ELSE html END"""


@BOOK.add("t10_extracted_articles", f"WITH {sql_articles(_RESHAPED)} SELECT * FROM articles")
def _articles(t: Tables) -> DataFrame:
    page, number = F.col("html"), F.col("page_id")

    def change(text: Column, old: str, new: Column | str) -> Column:
        return F.replace(text, F.lit(old), F.lit(new) if isinstance(new, str) else new)

    before = F.concat(F.lit("<main class='x'><p>Before page "), number.cast("string"), F.lit("</p><article>"))
    second = F.concat(
        F.lit("<article><p>Second of "), number.cast("string"),
        F.lit('<div class="related"><div><p>Inner box</div><p>After inner</p></div></article><p>Outside</p>'),
    )
    reshaped = (
        F.when(number % 4 == 0, F.concat(change(page, "<article>", before), F.lit("<p>After</p></main><p>Outside</p>")))
        .when(number % 4 == 1, F.concat(page, second))
        .when(number % 4 == 2, change(change(page, "<article>", "<div role='main'>"), "</article>", "</div>"))
        .otherwise(page)
    )
    return html.extract_articles(t.pages.withColumn("html", reshaped))


# Boxes inside removed boxes, removed elements of other names, one that is never closed.
_BOXED = """CASE page_id % 3
  WHEN 0 THEN replace(html, '</article>', '</article><div class="wide Related-box"><div>inner</div><div><div>more</div></div>after</div><p>End</p>')
  WHEN 1 THEN replace(html, '<article>', '<section id=''advert1''><section>x</section>y</section><ul class="nav share"><li>z</li></ul><article>') || '<aside><p>open'
  ELSE html END"""


@BOOK.add(
    "t09_pages_without_noise",
    f"""WITH toks AS (SELECT page_id, u.tok, u.i FROM (SELECT page_id, {_BOXED} AS html FROM pages),
            unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]*>|[^<]+')) WITH ORDINALITY AS u(tok, i)),
          tag AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS name, tok LIKE '</%' AS closing,
            lower(regexp_extract(tok, 'class=["'']([^"'']*)', 1)) AS cls, lower(regexp_extract(tok, 'id=["'']([^"'']*)', 1)) AS own FROM toks WHERE tok LIKE '<%'),
          deep AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY i) AS dn,
            NOT closing AND (name IN ('script', 'style', 'noscript', 'iframe', 'nav', 'header', 'footer', 'aside', 'form') OR regexp_matches(own, 'related|advert')
              OR regexp_matches(cls, 'advert|banner|social|related|recommend|share') OR list_has_any(string_split(cls, ' '), ['ad', 'ads'])) AS starts FROM tag),
          reg AS (SELECT s.page_id, s.i AS i0, CASE WHEN any_value(s.tok) LIKE '<!--%' THEN s.i ELSE coalesce(min(e.i), 1000000000) END AS i1 FROM deep s
            LEFT JOIN deep e ON e.page_id = s.page_id AND e.name = s.name AND e.closing AND e.i > s.i AND e.dn = s.dn - 1 WHERE s.starts OR s.tok LIKE '<!--%' GROUP BY 1, 2),
          cover AS (SELECT t.*, i0 IS NOT NULL AS starts, coalesce(max(i1) OVER (PARTITION BY t.page_id ORDER BY t.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= t.i AS inside
            FROM toks t LEFT JOIN reg r ON t.page_id = r.page_id AND t.i = r.i0)
        SELECT page_id, string_agg(CASE WHEN inside THEN '' WHEN starts THEN ' ' ELSE tok END, '' ORDER BY i) AS html FROM cover GROUP BY 1""",
)
def _noise(t: Tables) -> DataFrame:
    page, number = F.col("html"), F.col("page_id")
    box = '</article><div class="wide Related-box"><div>inner</div><div><div>more</div></div>after</div><p>End</p>'
    lists = "<section id='advert1'><section>x</section>y</section><ul class=\"nav share\"><li>z</li></ul><article>"
    boxed = (
        F.when(number % 3 == 0, F.replace(page, F.lit("</article>"), F.lit(box)))
        .when(number % 3 == 1, F.concat(F.replace(page, F.lit("<article>"), F.lit(lists)), F.lit("<aside><p>open")))
        .otherwise(page)
    )
    return t.pages.select("page_id", markup.remove_noise(boxed).alias("html"))


@BOOK.add(
    "f10_pages_of_domain",
    """SELECT page_id, url FROM pages WHERE regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) = 'tionsh.example.net'
       OR regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) LIKE '%.tionsh.example.net'""",
)
def _domain(t: Tables) -> DataFrame:
    return t.pages.filter(urls.in_domain(F.col("url"), "tionsh.example.net")).select("page_id", "url")


LINK_TERMS = ["the", "and", "die", "der", "les", "que", "nav", "one", "from"]


@BOOK.add(
    "f11_candidate_links",
    f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href="[^"]*"[^>]*>.*?</a\\s*>')) AS a,
               generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*href="[^"]*"[^>]*>.*?</a\\s*>'), 1) - 1 AS position FROM pages),
          l AS (SELECT page_id, url, position, {sql_squash(_sql_plain('a'))} AS title, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href FROM a),
          r AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
                  WHEN href LIKE '//%' THEN regexp_extract(url, '^[a-zA-Z]+:') || href
                  WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || href
                  ELSE regexp_extract(url, '^[a-zA-Z]+://[^?#]*/') || href END AS link FROM l)
        SELECT page_id, CAST(position AS INTEGER) AS position, title, link FROM r WHERE title <> '' AND href <> '' AND NOT regexp_matches(href, '^(#|mailto:|javascript:)')
          AND regexp_matches(link, '^https?://') AND list_has_any(string_split(lower(title), ' '), {LINK_TERMS})""",
)
def _links(t: Tables) -> DataFrame:
    return html.candidate_links(html.page_links(t.pages), LINK_TERMS).select("page_id", "position", "title", "link")


@BOOK.add(
    "f15_readable_pages",
    f"""SELECT page_id FROM (SELECT page_id, CASE WHEN url LIKE 'http:%' THEN url || '/login' WHEN url LIKE '%#top' THEN url || '/account' ELSE url END AS url,
          CASE WHEN url LIKE '%.example.com%' THEN '<p>Sign in</p>' || html ELSE html END AS html FROM pages)
        WHERE NOT (regexp_matches(lower({_sql_plain('html')}), '{html.LOGIN_TEXT}') AND regexp_matches(lower(url), '{html.LOGIN_URL}'))""",
)
def _readable(t: Tables) -> DataFrame:
    address = F.col("url")
    plain = F.startswith(address, F.lit("http:"))
    url = F.when(plain, F.concat(address, F.lit("/login"))).when(F.endswith(address, F.lit("#top")), F.concat(address, F.lit("/account"))).otherwise(address)
    page = F.when(F.contains(address, F.lit(".example.com")), F.concat(F.lit("<p>Sign in</p>"), F.col("html"))).otherwise(F.col("html"))
    return t.pages.filter(~html.is_login_page(url, page)).select("page_id")


@BOOK.add(
    "d03_first_page_per_host",
    """SELECT host, min_by(page_id, page_id) AS page_id, min_by(url, page_id) AS url
       FROM (SELECT *, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages) GROUP BY 1""",
)
def _first(t: Tables) -> DataFrame:
    pages = t.pages.select(urls.host(F.col("url")).alias("host"), "page_id", "url")
    return first_per_key(pages, ["host"], [F.col("page_id")])


@BOOK.add("d04_distinct_sources", "SELECT DISTINCT source FROM documents")
def _sources(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct()


@BOOK.add(
    "u03_ordered_distinct_union",
    f"""WITH u AS (SELECT 0 AS part, page_id AS pos, url, {SQL_TITLE} AS title FROM pages UNION ALL
               SELECT 1, page_id, replace(url, 'http:', 'https:'), {SQL_TITLE} FROM pages)
        SELECT url, title, min(part) AS part, min_by(pos, (part, pos)) AS pos FROM u GROUP BY 1, 2""",
)
def _union(t: Tables) -> DataFrame:
    titled = t.pages.select(F.lit(0).alias("part"), F.col("page_id").alias("pos"), "url", html.first_element(F.col("html"), *html.TITLE).alias("title"))
    again = titled.withColumns({"part": F.lit(1), "url": F.replace("url", F.lit("http:"), F.lit("https:"))})
    return first_per_key(titled.unionByName(again), ["url", "title"], [F.col("part"), F.col("pos")])


_EVIDENCE_SQL = """
WITH r AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN source = 'src3' THEN 4 WHEN lang = 'en' THEN 0 WHEN lang = 'de' THEN 1 WHEN lang = 'fr' THEN 2 ELSE 3 END AS kind FROM documents)
SELECT doc_id, CASE kind WHEN 3 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '#m' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS content,
  CASE kind WHEN 0 THEN 'id-' || doc_id WHEN 3 THEN 'meta-' || doc_id ELSE 'key/' || doc_id END AS document_id,
  CASE kind WHEN 0 THEN source WHEN 1 THEN lang WHEN 2 THEN 'internal_document' ELSE source || '.txt' END AS document_name,
  CAST(CASE kind WHEN 0 THEN n_chars WHEN 3 THEN 7 ELSE 0 END AS INTEGER) AS page,
  CAST(CASE kind WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS relevance, CAST(NULL AS VARCHAR) AS url, CASE kind WHEN 1 THEN 'docs' END AS bucket,
  CASE WHEN kind IN (1, 2) THEN 'key/' || doc_id END AS object_key FROM r WHERE kind <> 4
"""


@BOOK.add("p12_coalesced_evidence", _EVIDENCE_SQL)
def _evidence(t: Tables) -> DataFrame:
    """Records in four spellings by language; those of one source have no content."""
    doc = F.col("doc_id").cast("string")
    spelling = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    kind = F.when(F.col("source") == "src3", 4).otherwise(spelling)
    key = F.concat(F.lit("key/"), doc)
    shapes = [
        F.to_json(F.struct(F.col("text").alias("content"), F.concat(F.lit("id-"), doc).alias("id"), F.col("source").alias("title"), F.col("n_chars").alias("page"))),
        F.to_json(F.struct(F.lit("").alias("content"), F.col("text").alias("snippet"), F.col("lang").alias("filename"), F.lit("3.7").alias("page"),
                           F.lit(0.5).alias("relevance"), F.struct(key.alias("object_key"), F.lit("docs").alias("bucket")).alias("metadata"))),
        F.to_json(F.struct(F.col("text").alias("chunk"), key.alias("object_key"), F.lit("x").alias("page"), F.struct(F.lit("0.25").alias("relevance_score")).alias("metadata"))),
        F.to_json(F.struct(F.lit("  ").alias("content"), F.struct(F.concat("text", F.lit("#m")).alias("text"), F.concat(F.lit("meta-"), doc).alias("document_id"),
                           F.concat("source", F.lit(".txt")).alias("title"), F.lit(7).alias("page")).alias("metadata"))),
        F.to_json(F.struct(F.col("source").alias("title"))),
    ]
    json = shapes[-1]
    for i, shape in enumerate(shapes[:-1]):
        json = F.when(kind == i, shape).otherwise(json)
    return ev.parse_evidence(t.documents.select("doc_id", json.alias("json")))


@BOOK.add(
    "p13_display_sources",
    """SELECT page_id, url AS title, CASE WHEN page_id % 2 = 0 THEN 'external_news' ELSE 'internal_document' END AS source_type,
              CASE WHEN page_id % 3 = 0 THEN 'minio' END AS storage, 'news/' || page_id AS object_key, 0 AS page, CAST(0.25 AS DOUBLE) AS relevance, url,
              regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS domain, left(html, 150) || '...' AS snippet FROM pages""",
)
def _cards(t: Tables) -> DataFrame:
    records = t.pages.select(
        "page_id",
        F.lit("").alias("filename"),
        F.col("url").alias("title"),
        F.when(F.pmod("page_id", F.lit(2)) == 0, "external_news").alias("source_type"),
        F.when(F.pmod("page_id", F.lit(3)) == 0, "news").alias("bucket"),
        F.concat(F.lit("news/"), F.col("page_id").cast("string")).alias("object_key"),
        F.lit(0.25).alias("gaussian_score"),
        "url",
        F.col("html").alias("content"),
    )
    return ev.display_sources(records)


@BOOK.add(
    "f14_good_sources",
    """WITH s AS (SELECT doc_id, CASE WHEN lang = 'es' THEN NULL ELSE source || '/' || lang END AS identity, n_chars / 5000.0 AS relevance FROM documents)
       SELECT identity, min(doc_id) AS doc_id FROM s WHERE identity IS NOT NULL AND relevance >= 0.2 GROUP BY 1""",
)
def _good(t: Tables) -> DataFrame:
    key = F.when(F.col("lang") != "es", F.concat_ws("/", "source", "lang"))
    cards = t.documents.select("doc_id", key.alias("object_key"), (F.col("n_chars") / 5000).alias("relevance"))
    return ev.good_sources(cards, ["doc_id"]).select("identity", "doc_id")


@BOOK.add(
    "p14_rendered_records",
    """SELECT doc_id, chr(10) || '[SOURCE ' || (doc_id + 1) || ']' || chr(10) || 'File: ' || source || chr(10) || 'Bucket: unknown' || chr(10) || 'Object key: ' || lang || '/' || doc_id
         || chr(10) || 'Page: 0' || chr(10) || 'Chunk: 0' || chr(10) || 'Relevance: 0.500000' || chr(10) || chr(10) || 'Content:' || chr(10) || text || chr(10) AS block FROM documents""",
)
def _rendered(t: Tables) -> DataFrame:
    records = t.documents.select(
        "doc_id", "source", "text", (F.col("doc_id") + 1).alias("rank"),
        F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("object_key"), F.lit(0.5).alias("relevance_score"),
    )
    return records.select("doc_id", ev.render_context(records).alias("block"))


@BOOK.add(
    "p14_rendered_articles",
    f"""WITH {SQL_ARTICLES} SELECT page_id, concat_ws(chr(10), 'NEWS ' || (page_id + 1), '', 'Title: ' || title, 'Source: ' || regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1),
          'Published: ', 'URL: ' || url, 'Author: ', 'Category: ' || category, '', 'Content:', content) AS block FROM articles""",
)
def _rendered_articles(t: Tables) -> DataFrame:
    found = html.extract_articles(t.pages).withColumn("source", urls.host(F.col("url")))
    return found.select("page_id", ev.render_article(F.col("page_id") + 1, F.col("published_at"), F.col("author")).alias("block"))


@BOOK.add(
    "w09_numbered_evidence",
    f"""WITH {SQL_ARTICLES} SELECT 'evidence_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS evidence_id,
          'session-1' AS research_session_id, page_id, url, title FROM (SELECT *, row_number() OVER (ORDER BY page_id) AS n FROM articles)""",
)
def _numbered(t: Tables) -> DataFrame:
    found = materialise(html.extract_articles(t.pages).select("page_id", "url", "title"), "articles")
    return ev.number_evidence(found, ["page_id"], F.lit("session-1"))


@BOOK.add(
    "w08_recent_messages",
    """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) AS context
       FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY 1""",
)
def _recent(t: Tables) -> DataFrame:
    from saltmarsh.operators.conversation import recent_context

    return recent_context(t.conversations)


@BOOK.add(
    "j02_first_object_per_url",
    """WITH o AS (SELECT regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS url, 'obj/' || page_id AS object_key, page_id AS position FROM pages WHERE url LIKE 'https:%')
       SELECT page_id, p.url, f.object_key FROM (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS url FROM pages) p
       LEFT JOIN (SELECT url, min_by(object_key, position) AS object_key FROM o GROUP BY 1) f ON p.url = f.url""",
)
def _objects(t: Tables) -> DataFrame:
    hosts = t.pages.select("page_id", urls.host(F.col("url")).alias("url"))
    secure = t.pages.filter(F.startswith("url", F.lit("https:")))
    objects = secure.select(
        urls.host(F.col("url")).alias("url"),
        F.concat(F.lit("obj/"), F.col("page_id").cast("string")).alias("object_key"),
        F.col("page_id").alias("position"),
    )
    return ev.with_object_key(hosts, objects)


@BOOK.add(
    "j03_zipped_by_position",
    """WITH d AS (SELECT doc_id, string_split(text, '. ') AS a, string_split(text, chr(10)) AS b FROM documents)
       SELECT doc_id, CAST(i AS INTEGER) AS position, a[i + 1] AS sentence, b[i + 1] AS line FROM d, unnest(range(greatest(len(a), len(b)))) AS u(i)""",
)
def _zipped(t: Tables) -> DataFrame:
    lists = t.documents.select("doc_id", F.split("text", "\\. ").alias("sentence"), F.split("text", "\n").alias("line"))
    return ev.zip_by_position(lists, "sentence", "line")


@BOOK.add(
    "f04_searched_rows",
    """SELECT * FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')
       OR contains(CAST(p_partkey AS VARCHAR), 'ring') OR contains(CAST(p_size AS VARCHAR), 'ring') OR contains(CAST(p_retailprice AS VARCHAR), 'ring')""",
)
def _searched(t: Tables) -> DataFrame:
    return paging.search_rows(t.part, " Ring ")


@BOOK.add("o01_sorted_rows", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS p_size FROM part")
def _sorted(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    return paging.sort_rows(t.part.select("p_partkey", size.alias("p_size")), "p_size", descending=True, tiebreak=["p_partkey"])


@BOOK.add(
    "o02_page_of_rows",
    """SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), 'blue') ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 25 OFFSET 50""",
)
def _page(t: Tables) -> DataFrame:
    found = paging.search_rows(t.part.select("p_partkey", "p_name", "p_size"), "blue")
    return paging.page_rows(paging.sort_rows(found, "p_size", True, ["p_partkey"]), page=3, per_page=25)


@BOOK.add(
    "o02_page_info",
    """SELECT count(*) AS total, 3 AS page, 25 AS per_page, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS pages FROM part WHERE contains(lower(p_name), 'blue')""",
)
def _info(t: Tables) -> DataFrame:
    return paging.page_info(paging.search_rows(t.part.select("p_partkey", "p_name", "p_size"), "blue"), page=3, per_page=25)


@BOOK.add(
    "o02_stored_pages",
    """SELECT o_orderkey, o_totalprice, position, position // 40 + 1 AS page FROM (SELECT o_orderkey, o_totalprice,
         row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position, count(*) OVER () AS total FROM orders)
       WHERE position // 40 IN (0, 1, 200) OR position // 40 = (total - 1) // 40""",
)
def _stored_pages(t: Tables) -> DataFrame:
    """Orders sorted once; the first two pages, a deep one and the last are opened from the stored order."""
    path = run_folder(t.spark, "ordered")
    paging.store_ordered(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), path, F.desc("o_orderdate"), F.asc("o_orderkey"))
    last = paging.stored_info(t.spark, path, 1, 40).first()["pages"]
    pages = [paging.open_page(t.spark, path, page, 40).withColumn("page", F.lit(page).cast("long")) for page in sorted({1, 2, 201, last})]
    return reduce(DataFrame.unionByName, pages).select("o_orderkey", "o_totalprice", "position", "page")


@BOOK.add("o03_preview", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def _preview(t: Tables) -> DataFrame:
    return paging.preview(t.orders, 50, "o_orderdate", "o_orderkey")


@BOOK.add("o03_preview_info", "SELECT count(*) AS total, least(count(*), 50) AS shown, 'o_orderkey,o_orderdate' AS columns FROM orders")
def _preview_info(t: Tables) -> DataFrame:
    return paging.preview_info(t.orders.select("o_orderkey", "o_orderdate"), 50).withColumn("columns", F.array_join("columns", ","))


@BOOK.add("u01_union_by_name", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def _by_name(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


@BOOK.add("u02_union_all", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def _all(t: Tables) -> DataFrame:
    items = t.benchmark.select(F.col("item_id").alias("id"), "text")
    return t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(items)
