"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saltmarsh.catalog.base import Book
from saltmarsh.llm import exact, idfiles, manifest, mixing, neardup, neighbours, packing, secret_scan, suffixes, tokens, toxicity, variants, warc
from saltmarsh.scratch import run_folder

BOOK = Book()


@BOOK.add("op1_packed_windows")
def packed_windows(t) -> DataFrame:
    return packing.pack(t.documents, tokens.Vocabulary.named(), window=2048, end=1)


@BOOK.add("op4_bit_packed_ids")
def bit_packed_ids(t) -> DataFrame:
    path = run_folder(t.spark, "ids")
    idfiles.write_ids(t.documents, tokens.Vocabulary.named(), path, end=2)
    return idfiles.read_documents(t.spark, path)


@BOOK.add("op5_token_counts")
def token_counts(t) -> DataFrame:
    return tokens.count_tokens(t.documents, tokens.Vocabulary.named(), limit=512)


@BOOK.add("op8_toxicity")
def toxicity_scores(t) -> DataFrame:
    model = toxicity.fit(t.documents, t.labels)
    scored = toxicity.score(t.documents, model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@BOOK.add("op10_secret_spans")
def secret_spans(t) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(t.documents))


@BOOK.add("op7_near_duplicates")
def near_duplicate_classes(t) -> DataFrame:
    return neardup.near_duplicates(t.documents).select("doc_id", "class_id")


@BOOK.add("op2_mixed_sources")
def mixed_sources(t) -> DataFrame:
    return mixing.mix(t.documents).select("doc_id", "size", "source_size", "target", "taken")


@BOOK.add("op3_nearest_neighbours")
def nearest_neighbours(t) -> DataFrame:
    return neighbours.nearest(t.embeddings, every=50, k=5)


@BOOK.add(
    "op6_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id AS id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
        SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.id % 100 = 0 AND q.id <> c.id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def exact_top_k(t) -> DataFrame:
    return exact.top_k(t.embeddings, every=100, k=10)


# Captures made from the crawled pages, for the SQL: a full response of each, a revisit of it, a
# later revisit whose validator holds for two pages of three, and one of a url not fetched before.
_CAPTURES = """
    WITH full_responses AS (
        SELECT page_id, url, html, md5(html) AS tag, 10 * page_id AS seconds FROM pages
    )
    SELECT 4 * page_id AS record_id, 'response' AS warc_type, url AS target_uri, seconds, tag AS etag, html AS payload,
        'text/html' AS content_type, 'max-age=60' AS cache_control FROM full_responses
    UNION ALL
    SELECT 4 * page_id + 1, 'revisit', url, seconds + 3, concat('W/', tag), NULL, 'text/plain', 'max-age=600' FROM full_responses
    UNION ALL
    SELECT 4 * page_id + 2, 'revisit', replace(url, 'https://', 'http://www.'), seconds + 4000,
        CASE WHEN page_id % 3 = 0 THEN 'changed' ELSE tag END, NULL, NULL, NULL FROM full_responses
    UNION ALL
    SELECT 4 * page_id + 3, 'revisit', concat(url, '-not-seen'), seconds, tag, NULL, NULL, NULL FROM full_responses WHERE page_id % 10 = 0
"""


@BOOK.add(
    "op9_resolved_revisits",
    f"""
    WITH captures AS ({_CAPTURES}), parts AS (
        SELECT *, regexp_replace(regexp_replace(trim(target_uri), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '', 's') AS bare
        FROM captures
    ), cut AS (
        SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host,
            regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '[?].*$', '', 's') AS path,
            list_sort([p FOR p IN string_split(regexp_extract(bare, '[?](.*)$', 1, 's'), '&')
                IF p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid)(=|$)')]) AS params
        FROM parts
    ), keyed AS (
        SELECT *, host || regexp_replace(path, '/+$', '') ||
            CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url
        FROM cut
    ), latest AS (
        SELECT *, last_value(CASE WHEN warc_type = 'response' THEN record_id END IGNORE NULLS) OVER w AS source_id
        FROM keyed
        WINDOW w AS (PARTITION BY canonical_url ORDER BY seconds, warc_type, record_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    )
    SELECT l.record_id, l.canonical_url,
        CASE WHEN r.record_id IS NULL THEN 'no earlier response'
            WHEN regexp_replace(l.etag, '^W/', '') = regexp_replace(r.etag, '^W/', '') THEN 'resolved'
            ELSE 'validator differs' END AS outcome,
        CASE WHEN regexp_replace(l.etag, '^W/', '') = regexp_replace(r.etag, '^W/', '') THEN r.record_id END AS source_id,
        CASE WHEN regexp_replace(l.etag, '^W/', '') = regexp_replace(r.etag, '^W/', '') THEN md5(r.payload) END AS payload_md5,
        CASE WHEN regexp_replace(l.etag, '^W/', '') = regexp_replace(r.etag, '^W/', '')
            THEN 'cache-control=' || coalesce(l.cache_control, r.cache_control) || ';content-type=' || r.content_type || ';etag=' || l.etag
            END AS headers
    FROM latest l LEFT JOIN keyed r ON l.source_id = r.record_id
    WHERE l.warc_type = 'revisit'
    """,
)
def resolved_revisits(t) -> DataFrame:
    page, seconds, tag = F.col("page_id"), F.col("page_id") * 10, F.md5("html")

    def capture(number: int, kind: str, url: Column, after: int, present: Column | None = None, payload=None, **fields) -> Column:
        headers = F.create_map(*[x for name, value in fields.items() for x in (F.lit(name.replace("_", "-")), value)])
        return F.when(
            F.lit(True) if present is None else present,
            F.struct(
                (page * 4 + number).alias("record_id"),
                F.lit(kind).alias("warc_type"),
                url.alias("target_uri"),
                F.timestamp_seconds(seconds + after).alias("date"),
                headers.alias("headers"),
                (F.lit(None).cast("string") if payload is None else payload).alias("payload"),
            ),
        )

    url = F.col("url")
    captures = F.array(
        capture(0, "response", url, 0, payload=F.col("html"), etag=tag, content_type=F.lit("text/html"), cache_control=F.lit("max-age=60")),
        capture(1, "revisit", url, 3, ETag=F.concat(F.lit("W/"), tag), Content_Type=F.lit("text/plain"), Cache_Control=F.lit("max-age=600")),
        capture(2, "revisit", F.replace(url, F.lit("https://"), F.lit("http://www.")), 4000, etag=F.when(page % 3 == 0, "changed").otherwise(tag)),
        capture(3, "revisit", F.concat(url, F.lit("-not-seen")), 0, page % 10 == 0, etag=tag),
    )
    records = t.pages.select(F.inline(F.filter(captures, lambda c: c.isNotNull())))
    found = warc.resolve_revisits(records)
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select(
        "record_id", "canonical_url", "outcome", "source_id",
        F.md5("payload").alias("payload_md5"), F.nullif(F.concat_ws(";", pairs), F.lit("")).alias("headers"),
    )


@BOOK.add("op11_repeated_bytes")
def repeated_bytes(t) -> DataFrame:
    return suffixes.remove_repeats(t.documents, with_rest=False)


# The table of CRC-32, a step per bit.
_BITS = """bits AS (
        SELECT list(c ORDER BY i) AS tbl FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
            FROM (SELECT unnest(range(256)) AS i)
        )
    )"""


@BOOK.add(
    "op12_spelling_variants",
    rf"""
    WITH RECURSIVE {_BITS}, found AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents
    ), runs AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM found WHERE length(run) >= 6 GROUP BY ALL
    ), summed AS (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END
                FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')])),
            lambda c, b: xor(c // 256, tbl[xor(c, b) % 256 + 1])), 4294967295) AS h
        FROM runs, bits
    ), words AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed
        ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), cut AS (
        SELECT word, spot, substr(word, 1, spot) || substr(word, spot + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS spot FROM words)
    ), pairs AS (
        SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
        UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
        UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
    ), near AS (
        SELECT p.word, count(*) AS n_near, arg_min(p.other, (-w.n, encode(p.other))) AS best, max(w.n) AS best_n
        FROM pairs p JOIN words w ON p.other = w.word GROUP BY p.word
    ), forms AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
        FROM words w LEFT JOIN near USING (word)
    ), chain AS (
        SELECT word, word AS last FROM forms
        UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL
    )
    SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n
    FROM forms f JOIN chain c USING (word) JOIN forms e ON c.last = e.word WHERE e.form IS NULL
    """,
)
def spelling_variants(t) -> DataFrame:
    return variants.group_variants(variants.vocabulary(t.documents, damaged=199))


@BOOK.add(
    "op13_merkle_manifest",
    f"""
    WITH RECURSIVE {_BITS}, rows_ AS (
        SELECT d.*, row_number() OVER () AS rid,
            coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') AS head,
            coalesce(strlen(text) || ':' || text, '-') AS tail,
            xor(list_reduce(list_prepend(4294967295, [ascii(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
                lambda c, b: xor(c // 256, tbl[xor(c, b) % 256 + 1])), 4294967295) % 7 = 0 AS hit
        FROM documents d, bits
    ), leaves AS (
        SELECT doc_id, lang, rid, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
            CASE WHEN hit THEN sha256(head || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS tampered
        FROM rows_
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, tampered NULLS FIRST) - 1 AS rank FROM leaves
    ), steps AS (
        SELECT lang, 0 AS level, list(leaf ORDER BY rank) AS hs FROM placed GROUP BY lang
        UNION ALL
        SELECT lang, level + 1, list_transform(range((len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], '')))
        FROM steps WHERE len(hs) > 1
    ), subroots AS (
        SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM steps WHERE len(hs) = 1
    ), upper_ AS (
        SELECT 0 AS level, list(subroot ORDER BY place) AS hs FROM subroots
        UNION ALL
        SELECT level + 1, list_transform(range((len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], '')))
        FROM upper_ WHERE len(hs) > 1
    ), entries AS (
        SELECT p.rid, s.level, CASE WHEN (p.rank >> s.level) % 2 = 1 THEN 'l' || hs[p.rank >> s.level] ELSE 'r' || coalesce(hs[(p.rank >> s.level) + 2], '') END AS e
        FROM placed p JOIN steps s ON p.lang IS NOT DISTINCT FROM s.lang AND len(s.hs) > 1
        UNION ALL
        SELECT p.rid, 1000 + u.level, CASE WHEN (b.place >> u.level) % 2 = 1 THEN 'l' || hs[b.place >> u.level] ELSE 'r' || coalesce(hs[(b.place >> u.level) + 2], '') END
        FROM placed p JOIN subroots b ON p.lang IS NOT DISTINCT FROM b.lang JOIN upper_ u ON len(u.hs) > 1
    ), paths AS (
        SELECT rid, list(e ORDER BY level) AS path FROM entries GROUP BY rid
    ), folded AS (
        SELECT p.doc_id, p.leaf, b.subroot, (SELECT hs[1] FROM upper_ WHERE len(hs) = 1) AS root,
            sha256(array_to_string([e[2:] FOR e IN coalesce(path, [])], '')) AS proof_sha256,
            list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(path, [])), lambda h, e: sha256(CASE WHEN e[1] = 'l' THEN e[2:] || h ELSE h || e[2:] END)) AS folded_root
        FROM placed p JOIN subroots b ON p.lang IS NOT DISTINCT FROM b.lang LEFT JOIN paths q ON p.rid = q.rid
    )
    SELECT *, folded_root = root AS verified FROM folded
    """,
)
def merkle_manifest(t) -> DataFrame:
    return manifest.verified_documents(t.documents)
