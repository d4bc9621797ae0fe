"""Text functions over documents, conversations and urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.functions import text as tx, urls
from saltmarsh.operators import chunking
from saltmarsh.operators.activity import classify_error
from saltmarsh.operators.rows import materialise, number_rows

BOOK = Book()

# The white-space class in the SQL engine's syntax.
WS = (
    r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP = f"'^{WS}+|{WS}+$', '', 'g'"


def sql_squash(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WS}+', ' ', 'g'))"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, {STRIP})"


def sql_tidy(column: str) -> str:
    return sql_strip(f"regexp_replace(regexp_replace({column}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


# Text with more to clean than the table itself: tabs, wide gaps and empty lines.
def noisy():
    gaps = F.replace("text", F.lit(". "), F.lit(".  \t"))
    return F.concat(F.lit(" \t"), gaps, F.lit("\n\n\n\n"), F.col("source"), F.lit("\xa0 \n"))


SQL_NOISY = "(' ' || chr(9) || replace(text, '. ', '.  ' || chr(9)) || chr(10) || chr(10) || chr(10) || chr(10) || source || chr(160) || ' ' || chr(10))"


@BOOK.add("t01_tidy_text", f"SELECT doc_id, {sql_tidy(SQL_NOISY)} AS text FROM documents")
def _tidy(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.tidy_extracted(noisy()).alias("text"))


@BOOK.add("t02_squashed_text", f"SELECT doc_id, {sql_squash(SQL_NOISY)} AS text FROM documents")
def _squash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.squash(noisy()).alias("text"))


# Every line of a document becomes a page of its own, after an unmarked preface.
def marked_documents(t: Tables) -> DataFrame:
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(F.lit("===== PAGE "), (i + 1).cast("string"), F.lit(" =====\n"), line, F.lit("\n")),
    )
    return t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"),
        F.concat(F.lit("preface\n"), F.array_join(lines, "")).alias("text"),
    )


_PAGES = f"""pages_ AS (SELECT 'doc-' || doc_id || '.txt' AS source, CAST(u.page AS INTEGER) AS page, {sql_tidy('u.line')} AS text
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, page)),
  kept AS (SELECT * FROM pages_ WHERE text <> '')"""


@BOOK.add("t03_marked_pages", f"WITH {_PAGES} SELECT * FROM kept")
def _pages(t: Tables) -> DataFrame:
    pages = marked_documents(t).select("source", F.explode(tx.marked_pages(F.col("text"))).alias("p"))
    return pages.select("source", "p.page", "p.text")


def sql_chunks(table: str, keys: str, size: int = 1000, step: int = 850) -> str:
    return f"""cut AS (SELECT {keys}, k, {sql_strip(f'substring(text, CAST(k AS BIGINT) * {step} + 1, {size})')} AS text
      FROM {table}, unnest(range(CAST(ceil(length(text) / {step}.0) AS BIGINT))) AS u(k)),
      chunked AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY k) - 1 AS INTEGER) AS chunk, text FROM cut WHERE text <> '')"""


@BOOK.add("t04_chunked_documents", f"WITH {sql_chunks('documents', 'doc_id')} SELECT * FROM chunked")
def _chunks(t: Tables) -> DataFrame:
    return chunking.chunk_documents(t.documents.select("doc_id", "text"))


@BOOK.add(
    "w07_numbered_chunks",
    f"""WITH {_PAGES}, {sql_chunks('kept', 'source, page')}
        SELECT source, page, chunk, text, row_number() OVER (ORDER BY source, page, chunk) - 1 AS chunk_id FROM chunked""",
)
def _numbered(t: Tables) -> DataFrame:
    """The chunks are written once; numbering reads them three times."""
    chunks = materialise(chunking.page_chunks(marked_documents(t)), "chunks")
    return number_rows(chunks, ["source", "page", "chunk"], "chunk_id")


_ARTICLE_SQL = f"""
WITH a AS (SELECT doc_id, 'https://news.example.org/' || source || '/d-' || doc_id || '/x' AS url, source AS title, {sql_strip('text')} AS body FROM documents),
cut AS (SELECT a.*, k, {sql_strip('substring(body, CAST(k AS BIGINT) * 4000 + 1, 4500)')} AS piece
        FROM a, unnest(range(CAST(ceil(length(body) / 4000.0) AS BIGINT))) AS u(k) WHERE k = 0 OR (k - 1) * 4000 + 4500 <= length(body))
SELECT doc_id, url, title, left(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g'), '-'), 100) AS article_id, CAST(k AS INTEGER) AS chunk,
       left(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g'), '-'), 100) || '-' || k AS chunk_id, title || chr(10) || chr(10) || piece AS text
FROM cut WHERE piece <> ''
"""


def document_articles(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://news.example.org/"), F.col("source"), F.lit("/d-"), F.col("doc_id").cast("string"), F.lit("/x"))
    return t.documents.select("doc_id", url.alias("url"), F.col("source").alias("title"), F.col("text").alias("content"))


@BOOK.add("t05_article_chunks", _ARTICLE_SQL)
def _article_chunks(t: Tables) -> DataFrame:
    return chunking.article_chunks(document_articles(t))


@BOOK.add(
    "t06_clean_paragraphs",
    f"""WITH p AS (SELECT doc_id, u.i, {sql_squash('u.p')} AS p FROM documents,
              unnest(string_split(text || chr(10) || 'Baca juga: ' || source || chr(10) || text, chr(10))) WITH ORDINALITY AS u(p, i)),
            k AS (SELECT doc_id, p, min(i) AS i FROM p WHERE p <> '' AND NOT (contains(lower(p), 'baca juga:') OR contains(lower(p), 'advertisement')
                 OR contains(lower(p), 'sponsored') OR contains(lower(p), 'ikuti kami')) GROUP BY 1, 2)
       SELECT d.doc_id, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i), '') AS text FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1""",
)
def _paragraphs(t: Tables) -> DataFrame:
    doubled = F.concat_ws("\n", "text", F.concat(F.lit("Baca juga: "), F.col("source")), "text")
    return t.documents.select("doc_id", tx.clean_paragraphs(F.split(doubled, "\n")).alias("text"))


def _answer():
    escaped = F.replace("text", F.lit(". "), F.lit(".\\n"))
    return F.concat(escaped, F.lit("\n>>sources>>\n a, b <<\n***\n Sources: \n>>>\n\n\n\n<<<\n"), F.col("role"))


_SQL_ANSWER = (
    "(replace(text, '. ', '.\\n') || chr(10) || '>>sources>>' || chr(10) || ' a, b <<' || chr(10) || '***' || chr(10) || ' Sources: '"
    " || chr(10) || '>>>' || repeat(chr(10), 4) || '<<<' || chr(10) || role)"
)


def _sql_answer() -> str:
    out = f"replace(replace(replace({_SQL_ANSWER}, '\\r\\n', chr(10)), '\\n', chr(10)), chr(13) || chr(10), chr(10))"
    for pattern in tx.ANSWER_MARKUP:
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return sql_strip(f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


@BOOK.add("t07_clean_answers", f"SELECT conv_id, turn, {_sql_answer()} AS answer FROM conversations")
def _answers(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.clean_answer(_answer()).alias("answer"))


@BOOK.add(
    "t08_unwrapped_answers",
    "SELECT conv_id, turn, CASE WHEN role = 'system' THEN '{\"text\":' || to_json(text) || '}' ELSE text END AS answer FROM conversations",
)
def _unwrapped(t: Tables) -> DataFrame:
    """Assistant turns arrive as JSON with an answer, system turns as JSON without, user turns bare."""
    wrapped = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.col("text").alias("answer")))).otherwise(
        F.when(F.col("role") == "system", F.to_json(F.struct("text"))).otherwise(F.col("text"))
    )
    return t.conversations.select("conv_id", "turn", tx.unwrap_answer(wrapped).alias("answer"))


@BOOK.add(
    "t11_slugs",
    """SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown_source') AS slug,
              'unknown_source' AS empty_slug FROM pages""",
)
def _slugs(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.slug(F.col("url")).alias("slug"), tx.slug(F.lit("--")).alias("empty_slug"))


_PAGE_SOURCE = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@BOOK.add(
    "t12_object_keys",
    f"""WITH p AS (SELECT page_id, {_PAGE_SOURCE} AS src, CASE WHEN url LIKE 'https:%' THEN url || '/d-' || page_id ELSE url END AS u FROM pages)
        SELECT page_id, trim(regexp_replace(lower(src), '[^a-z0-9]+', '_', 'g'), '_') || '/' ||
          CASE WHEN regexp_matches(u, '(^|/)d-([0-9]+)(/|$|-)') THEN 'd-' || regexp_extract(u, '(^|/)d-([0-9]+)(/|$|-)', 2) ELSE sha256(u) END || '.json' AS object_key FROM p""",
)
def _keys(t: Tables) -> DataFrame:
    url = F.when(F.startswith("url", F.lit("https:")), F.concat("url", F.lit("/d-"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return t.pages.select("page_id", urls.object_key(urls.host(F.col("url")), url).alias("object_key"))


@BOOK.add(
    "t13_artifact_ids",
    "SELECT page_id, sha256(url) AS artifact_id, left(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g'), '-'), 100) AS article_id FROM pages",
)
def _ids(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.artifact_id(F.col("url")).alias("artifact_id"), urls.article_id(F.col("url")).alias("article_id"))


@BOOK.add(
    "t14_topic_names",
    f"""WITH q AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Berita ' || p_name || ' hari ini' WHEN 1 THEN 'latest NEWS today' ELSE p_name || '''s 2nd-hand, ' END AS q FROM part),
        c AS (SELECT p_partkey, trim({sql_squash("regexp_replace(q, '(?i)\\b(news|berita|hari ini|today|terbaru|latest)\\b', ' ', 'g')")}, ' ,.-') AS v FROM q)
        SELECT p_partkey, coalesce(nullif(array_to_string(list_transform(regexp_extract_all(lower(v), '(\\p{{L}}+|[^\\p{{L}}]+)'),
               lambda x: upper(x[1]) || substring(x, 2)), ''), ''), 'General News') AS topic FROM c""",
)
def _topics(t: Tables) -> DataFrame:
    kind = F.col("p_size") % 3
    query = (
        F.when(kind == 0, F.concat(F.lit("Berita "), F.col("p_name"), F.lit(" hari ini")))
        .when(kind == 1, "latest NEWS today")
        .otherwise(F.concat("p_name", F.lit("'s 2nd-hand, ")))
    )
    return t.part.select("p_partkey", tx.topic_name(query).alias("topic"))


@BOOK.add(
    "t15_tokens",
    """SELECT doc_id, token, min(i) AS first_at FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*')) AS token,
         generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*'), 1) AS i FROM documents) GROUP BY 1, 2
       QUALIFY true""".replace("min(i) AS first_at", "CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS INTEGER) AS position"),
)
def _tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("position", "token"))


@BOOK.add(
    "t24_content_types",
    """WITH k AS (SELECT page_id, split_part(split_part(regexp_replace(url, '/$', ''), '?', 1), '#', 1) AS key FROM pages),
            n AS (SELECT page_id, regexp_extract(key, '[^/]*$') AS file_name FROM k)
       SELECT page_id, file_name, CASE WHEN file_name LIKE '%.html' THEN regexp_replace(file_name, '\\.html$', '') ELSE file_name END AS file_stem,
              CASE WHEN file_name LIKE '%.html' THEN 'text/html' ELSE 'application/octet-stream' END AS content_type FROM n""",
)
def _types(t: Tables) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace("url", "/$", ""), r"[?#].*$", "")
    return t.pages.select(
        "page_id",
        urls.file_name(key).alias("file_name"),
        urls.file_stem(key).alias("file_stem"),
        urls.content_type(key).alias("content_type"),
    )


@BOOK.add(
    "t25_error_classes",
    """WITH e AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'HTTP 429 from model' WHEN 1 THEN 'status UNAVAILABLE' WHEN 2 THEN 'error 500'
                    WHEN 3 THEN 'Deadline exceeded' ELSE 'bad ' || event_type END || ' ' || CAST(event_id AS VARCHAR) AS m FROM events)
       SELECT event_id, CASE WHEN regexp_matches(m, '429|RESOURCE_EXHAUSTED') THEN 'GEMINI_429' WHEN regexp_matches(m, '503|UNAVAILABLE') THEN 'GEMINI_503'
                WHEN regexp_matches(m, '500|INTERNAL') THEN 'GEMINI_500' WHEN regexp_matches(lower(m), 'deadline|timeout') THEN 'GEMINI_TIMEOUT'
                ELSE 'ANSWER_GENERATION_FAILED' END AS code,
              CASE WHEN regexp_matches(m, '429|RESOURCE_EXHAUSTED') THEN 429 WHEN regexp_matches(m, '503|UNAVAILABLE') THEN 503
                WHEN regexp_matches(m, '500|INTERNAL') THEN 500 END AS http_status,
              regexp_matches(m, '429|RESOURCE_EXHAUSTED|503|UNAVAILABLE') OR (NOT regexp_matches(m, '500|INTERNAL') AND regexp_matches(lower(m), 'deadline|timeout')) AS retryable
       FROM e""",
)
def _errors(t: Tables) -> DataFrame:
    kind = F.pmod("user_id", F.lit(5))
    head = (
        F.when(kind == 0, "HTTP 429 from model")
        .when(kind == 1, "status UNAVAILABLE")
        .when(kind == 2, "error 500")
        .when(kind == 3, "Deadline exceeded")
        .otherwise(F.concat(F.lit("bad "), F.col("event_type")))
    )
    message = F.concat_ws(" ", head, F.col("event_id").cast("string"))
    return t.events.select("event_id", *[c.alias(n) for n, c in classify_error(message).items()])
