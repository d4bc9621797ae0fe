"""Vector search over the embeddings and hybrid retrieval over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.catalog.texts import sql_chunks
from saltmarsh.functions import questions as qs, vectors as vx
from saltmarsh.operators import ranking as rk, text_index, vector_index
from saltmarsh.operators.rows import filter_computed, materialise
from saltmarsh.operators.vectorize import hash_vectors
from saltmarsh.plans.indexing import index_rows, internal_rows, news_rows
from saltmarsh.plans.retrieval import Embedder, evidence_context, hashing, retrieve
from saltmarsh.scratch import run_folder
from saltmarsh.sources import snapshots

BOOK = Book()

QUESTION = "the and with from are"


def label_centres(t: Tables) -> DataFrame:
    """Mean vector of every label: one query vector per label."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v"))
    return listed.select(F.col("label").cast("bigint").alias("query_id"), F.col("v.m").alias("embedding"))


CENTRES = """cells AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY 1, 2),
  centres AS (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY i) AS v FROM means GROUP BY 1)"""


def _gap(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"


NEAR = f"""{CENTRES}, dist AS (SELECT query_id, vec_id, label, {_gap('embedding', 'v')} AS distance FROM embeddings, centres),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM dist)"""


def with_own_centre(t: Tables) -> DataFrame:
    """Every vector beside the centre of its label."""
    centres = label_centres(t).withColumnRenamed("embedding", "centre")
    vectors = t.embeddings.select("vec_id", F.col("label").cast("bigint").alias("query_id"), "embedding")
    return vectors.join(centres, "query_id")


@BOOK.add("v01_distance_to_centre", f"WITH {NEAR} SELECT vec_id, round(distance, 6) AS distance FROM dist WHERE label = query_id")
def _distance(t: Tables) -> DataFrame:
    return with_own_centre(t).select("vec_id", F.round(vx.squared_l2(F.col("embedding"), F.col("centre")), 6).alias("distance"))


def candidates(t: Tables, k: int = rk.CANDIDATES) -> DataFrame:
    return rk.nearest(t.embeddings, label_centres(t), key="vec_id", k=k)


def _round6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@BOOK.add("v02_nearest_vectors", f"WITH {NEAR} SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 20")
def _nearest(t: Tables) -> DataFrame:
    return _round6(candidates(t), "distance")


@BOOK.add("j07_queries_by_vectors", f"WITH {NEAR} SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 5")
def _loop(t: Tables) -> DataFrame:
    return _round6(candidates(t, k=5), "distance")


@BOOK.add(
    "f09_nearest_with_filter",
    f"""WITH {NEAR} SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM dist WHERE label = 1) WHERE rank <= 20""",
)
def _filtered(t: Tables) -> DataFrame:
    found = rk.nearest(t.embeddings, label_centres(t), key="vec_id", where=F.col("label") == 1)
    return _round6(found, "distance")


def _index_of(t: Tables, vectors: DataFrame) -> str:
    """Every label is an object."""
    path = run_folder(t.spark, "vectors")
    vector_index.build(vectors, path, "vec_id", object_key="label", carried=["label"])
    return path


_INDEXED = f"WITH {NEAR} SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= "


@BOOK.add("v02_indexed_vectors", _INDEXED + "20")
def _indexed(t: Tables) -> DataFrame:
    """The exact search of an index over all vectors."""
    found = vector_index.search(t.spark, _index_of(t, t.embeddings), label_centres(t), 20, name="vec_id", exact=True)
    return _round6(found, "distance")


@BOOK.add("v02_updated_vectors", _INDEXED + "5")
def _reindexed(t: Tables) -> DataFrame:
    """Half of the labels were indexed with other vectors first; as objects they are then replaced."""
    turned = t.embeddings.withColumn("embedding", F.when(F.col("label") % 2 == 1, F.reverse("embedding")).otherwise(F.col("embedding")))
    path = _index_of(t, turned)
    vector_index.update(t.embeddings.filter("label % 2 = 1"), path, "vec_id", object_key="label", carried=["label"])
    return _round6(vector_index.search(t.spark, path, label_centres(t), 5, name="vec_id", exact=True), "distance")


@BOOK.add(
    "f09_indexed_with_filter",
    f"""WITH {NEAR} SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM dist WHERE label = 1) WHERE rank <= 20""",
)
def _indexed_filtered(t: Tables) -> DataFrame:
    path = _index_of(t, t.embeddings)
    found = vector_index.search(t.spark, path, label_centres(t), 20, name="vec_id", where=F.col("label") == 1, exact=True)
    return _round6(found, "distance")


@BOOK.add("j07_index_recall", "SELECT vec_id AS query_id, TRUE AS in_range, CAST(10 AS INTEGER) AS found FROM embeddings WHERE embedding IS NOT NULL")
def _recall(t: Tables) -> DataFrame:
    """Every vector asked against the index without the exact step, compared with the scan: recall over all of them is in range."""
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    quick = vector_index.search(t.spark, _index_of(t, t.embeddings), asked, 10, name="vec_id")
    scanned = rk.nearest(t.embeddings, asked, key="vec_id", k=10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    judged = quick.join(scanned, ["query_id", "vec_id"], "left").groupBy("query_id")
    judged = materialise(judged.agg(F.count("hit").alias("hits"), F.count(F.lit(1)).cast("int").alias("found")), "judged")
    recall = judged.agg(F.sum("hits") / F.sum("found")).first()[0]
    return judged.select("query_id", F.lit(recall >= 0.95).alias("in_range"), "found")


@BOOK.add(
    "v03_gaussian_scores",
    f"WITH {NEAR} SELECT vec_id, round(exp(-(distance * distance) / (2 * 0.25 * 0.25)), 6) AS score FROM dist WHERE label = query_id",
)
def _gaussian(t: Tables) -> DataFrame:
    return with_own_centre(t).select("vec_id", F.round(vx.gaussian_score(vx.squared_l2(F.col("embedding"), F.col("centre"))), 6).alias("score"))


_WORDS = [w for w in dict.fromkeys(QUESTION.split()) if len(w) > 2 and w not in qs.STOP_WORDS]
_HITS = f"""tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*')) AS w FROM documents),
  hit AS (SELECT doc_id, count(*) FILTER (w IN ({', '.join("'" + w + "'" for w in _WORDS)})) AS hits FROM tok GROUP BY 1)"""
_HYBRID = f"""WITH {NEAR}, {_HITS}, cand AS (SELECT query_id, vec_id, distance, rank, coalesce(hits, 0) AS hits FROM near JOIN documents ON doc_id = vec_id LEFT JOIN hit USING (doc_id) WHERE rank <= 20),
  s AS (SELECT *, least(1.0, hits / {len(_WORDS)}.0) AS keyword_score, exp(-(distance * distance) / 0.125) AS gaussian_score FROM cand),
  h AS (SELECT *, 0.7 * gaussian_score + 0.3 * keyword_score AS relevance_score FROM s)"""


def scored_candidates(t: Tables) -> DataFrame:
    """Nearest vectors with the text of the document of the same number."""
    question = rk.understand(t.spark.range(1).select(F.lit(QUESTION).alias("text"))).first()
    words = F.array(*[F.lit(w) for w in question["keywords"]])
    texts = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    return candidates(t).join(texts, "vec_id").withColumn("keywords", words)


@BOOK.add(
    "v04_hybrid_scores",
    _HYBRID + " SELECT query_id, vec_id, round(keyword_score, 6) AS keyword_score, round(relevance_score, 6) AS relevance_score FROM h",
)
def _hybrid(t: Tables) -> DataFrame:
    rows = scored_candidates(t)
    hits = rk.keyword_hits(F.col("text"), F.col("keywords"))
    return rows.select(
        "query_id",
        "vec_id",
        F.round(vx.keyword_share(hits, F.size("keywords")), 6).alias("keyword_score"),
        F.round(vx.hybrid_score(F.col("distance"), hits, F.size("keywords")), 6).alias("relevance_score"),
    )


@BOOK.add(
    "o04_reranked_top",
    _HYBRID + """ SELECT query_id, vec_id, round(relevance_score, 6) AS relevance_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, rank) AS INTEGER) AS final_rank
      FROM h WHERE relevance_score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, rank) <= 5""",
)
def _reranked(t: Tables) -> DataFrame:
    top = rk.rerank(scored_candidates(t))
    return top.select("query_id", "vec_id", F.round("relevance_score", 6).alias("relevance_score"), "final_rank")


@BOOK.add(
    "f13_relevant_documents",
    f"""WITH {_HITS}, s AS (SELECT doc_id, n_chars / 10000.0 AS relevance, coalesce(hits, 0) AS hits, CASE WHEN lang = 'en' THEN 3 ELSE 5 END AS words FROM documents LEFT JOIN hit USING (doc_id))
        SELECT doc_id FROM s WHERE CASE WHEN words <= 3 THEN least(1.0, hits / words) > 0 AND relevance >= 0.75 ELSE relevance >= 0.2 END""",
)
def _relevant(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in _WORDS])
    count = F.when(F.col("lang") == "en", 3).otherwise(5)
    share = vx.keyword_share(rk.keyword_hits(F.col("text"), words), count)
    return t.documents.filter(rk.relevant(count, share, F.col("n_chars") / 10000)).select("doc_id")


@BOOK.add("j06_keyword_matches", f"WITH {_HITS} SELECT doc_id, coalesce(hits, 0) AS hits FROM documents LEFT JOIN hit USING (doc_id)")
def _matches(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in _WORDS])
    return t.documents.select("doc_id", rk.keyword_hits(F.col("text"), words).cast("bigint").alias("hits"))


def _text_index(t: Tables, documents: DataFrame) -> str:
    """Every source is an object."""
    path = run_folder(t.spark, "postings")
    text_index.build(documents, path, "doc_id", object_key="source")
    return path


@BOOK.add("j06_indexed_matches", f"WITH {_HITS} SELECT doc_id, hits FROM hit WHERE hits > 0")
def _indexed_matches(t: Tables) -> DataFrame:
    found = text_index.TextIndex(t.spark, _text_index(t, t.documents)).matches(_WORDS)
    return found.withColumnRenamed("key", "doc_id")


_RANKED = """WITH tok AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*')) AS w FROM documents) GROUP BY 1, 2),
  df AS (SELECT w, count(*) AS df FROM tok GROUP BY 1), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*')) AS w FROM benchmark),
  s AS (SELECT item_id AS query_id, doc_id, round(sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * n / (n + 1.2)), 6) AS score
        FROM q JOIN df USING (w) JOIN tok USING (w) GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"""


def _ranked_documents(t: Tables, path: str) -> DataFrame:
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), text_index.words_of(F.col("text")).alias("keywords"))
    return text_index.TextIndex(t.spark, path).ranked(asked, 10).withColumnRenamed("key", "doc_id")


@BOOK.add("j06_ranked_documents", _RANKED)
def _ranked(t: Tables) -> DataFrame:
    """Every benchmark passage asked against the texts of all documents."""
    return _ranked_documents(t, _text_index(t, t.documents))


@BOOK.add("j06_updated_ranks", _RANKED)
def _updated_ranks(t: Tables) -> DataFrame:
    """Sources that hold an even document were indexed with other texts first; as objects they are then replaced."""
    # Written first, so that its size is known and texts are not shuffled by their few sources.
    changed = materialise(t.documents.filter("doc_id % 2 = 0").select("source").distinct(), "changed")
    stale = t.documents.join(changed.withColumn("stale", F.lit("old words ")), "source", "left")
    path = _text_index(t, stale.withColumn("text", F.concat(F.coalesce("stale", F.lit("")), F.col("text"))))
    text_index.update(t.documents.join(changed, "source", "left_semi"), path, "doc_id", object_key="source")
    return _ranked_documents(t, path)


@BOOK.add("f06_indexed_substring", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'thster') OR contains(lower(text), 'elle un')")
def _indexed_substring(t: Tables) -> DataFrame:
    """Documents that hold one of two strings, found by trigrams and then looked at."""
    path = run_folder(t.spark, "trigrams")
    text_index.build(t.documents, path, "doc_id", terms=text_index.trigrams_of)
    index = text_index.TextIndex(t.spark, path)
    found = [index.containing(t.documents, needle, "doc_id").select("doc_id", "source") for needle in ("THster", "elle un")]
    return found[0].union(found[1]).distinct()


@BOOK.add(
    "u06_shared_tokens",
    f"""WITH tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*')) AS w FROM documents)
        SELECT doc_id, w AS token FROM tok WHERE w IN ({', '.join("'" + w + "'" for w in _WORDS)})""",
)
def _shared(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in _WORDS])
    from saltmarsh.functions.text import tokens

    return t.documents.select("doc_id", F.explode(F.array_intersect(words, tokens(F.col("text")))).alias("token"))


_URLS = """urls AS (SELECT query_id, 'https://docs.example.org/' || label AS url, distance FROM near WHERE rank <= 20)"""


def url_candidates(t: Tables) -> DataFrame:
    """Candidates as chunks of a document per label."""
    labels = t.embeddings.select("vec_id", F.concat(F.lit("https://docs.example.org/"), F.col("label").cast("string")).alias("url"))
    return candidates(t).join(labels, "vec_id")


@BOOK.add("d05_best_score_per_url", f"WITH {NEAR}, {_URLS} SELECT query_id, url, round(max(1 / (1 + distance)), 6) AS score FROM urls GROUP BY 1, 2")
def _best(t: Tables) -> DataFrame:
    return _round6(rk.best_score_per_url(url_candidates(t), "query_id"), "score")


_SCORED = f"""WITH {NEAR}, {_URLS}, b AS (SELECT url, max(1 / (1 + distance)) AS score FROM urls GROUP BY 1),
  a AS (SELECT doc_id, 'https://docs.example.org/' || (doc_id % 16) AS url FROM documents)
SELECT doc_id, a.url, round(coalesce(score, 0), 6) AS relevance_score FROM a LEFT JOIN b ON a.url = b.url"""


def scored_articles(t: Tables) -> tuple[DataFrame, DataFrame]:
    number = F.pmod("doc_id", F.lit(16)).cast("string")
    articles = t.documents.select("doc_id", F.concat(F.lit("https://docs.example.org/"), number).alias("url"))
    return articles, rk.best_score_per_url(url_candidates(t))


@BOOK.add("j01_articles_with_scores", _SCORED)
def _with_scores(t: Tables) -> DataFrame:
    return rk.attach_scores(*scored_articles(t))


@BOOK.add("v05_top_articles", _SCORED + " ORDER BY relevance_score DESC, doc_id LIMIT 15")
def _top(t: Tables) -> DataFrame:
    return rk.top_articles(*scored_articles(t), 15, "doc_id")


@BOOK.add(
    "v06_confidence",
    """SELECT user_id, CAST(least(0.98, 0.45 + 0.1 * count(*) FILTER (event_type = 'signup')) AS DOUBLE) AS evidence_confidence,
              greatest(35, least(98, 45 + 16 * count(*) FILTER (event_type = 'purchase') - 10 * count(*) FILTER (event_type = 'error'))) AS run_confidence
       FROM events GROUP BY 1""",
)
def _confidence(t: Tables) -> DataFrame:
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    counted = t.events.groupBy("user_id").agg(
        count("signup").alias("found"), count("purchase").alias("ok"), count("error").alias("bad")
    )
    return counted.select(
        "user_id",
        F.round(vx.evidence_confidence(F.col("found")), 6).alias("evidence_confidence"),
        vx.run_confidence(F.col("ok"), F.col("bad")).alias("run_confidence"),
    )


@BOOK.add(
    "v07_hash_vectors",
    """WITH n AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 256 AS slot, count(*) AS n
          FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*')) AS w FROM documents) GROUP BY 1, 2),
        s AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS length FROM n GROUP BY 1)
        SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(n / length, 6) AS value FROM n JOIN s USING (doc_id)""",
)
def _vectors(t: Tables) -> DataFrame:
    """Every component of every vector that is not zero."""
    made = hash_vectors(t.documents.select("doc_id", "text"), dimensions=256, kind="double")
    return made.select("doc_id", F.posexplode("embedding").alias("slot", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))


def document_index(t: Tables, dimensions: int = 256, documents: DataFrame | None = None, embed: Embedder | None = None) -> DataFrame:
    """Index rows: documents without label as internal objects, labelled ones as news."""
    keyed = (t.documents if documents is None else documents).select(
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("object_key"), "doc_id", "source", "text"
    )
    # One join for both kinds: a filter that stays above it leaves them the same shuffle of texts.
    marked = keyed.join(t.labels.select("doc_id").distinct().withColumn("labelled", F.lit(True)), "doc_id", "left")
    kept = ["object_key", "doc_id", "source"]
    internal = filter_computed(marked, F.col("labelled").isNull()).select(*kept, F.lit(0).alias("page"), "text")
    news = filter_computed(marked, F.col("labelled").isNotNull()).select(*kept, F.col("text").alias("content"))
    return index_rows(internal_rows(internal, "documents"), news_rows(news), embed or hashing(dimensions))


@BOOK.add(
    "v08_index_snapshot",
    f"""WITH {sql_chunks('documents', 'doc_id, source')}, f AS (SELECT doc_id, md5(text) AS etag FROM documents)
        SELECT CASE WHEN l.doc_id IS NULL THEN 'minio:documents:' || source || '/' || c.doc_id || '.txt:' || etag || ':0:' || chunk
                    ELSE 'news:' || source || '/' || c.doc_id || '.txt:' || chunk END AS id,
               CASE WHEN l.doc_id IS NULL THEN 'internal_document' ELSE 'external_news' END AS source_type, chunk, c.text, 256 AS dimensions
        FROM chunked c JOIN f USING (doc_id) LEFT JOIN labels l ON l.doc_id = c.doc_id""",
)
def _snapshot(t: Tables) -> DataFrame:
    return document_index(t).select("id", "source_type", "chunk", "text", F.size("embedding").alias("dimensions"))


@BOOK.add(
    "v08_replaced_snapshot",
    f"""WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 1 THEN text || ' old' ELSE text END AS text FROM documents),
          {sql_chunks('d', 'doc_id, source')} SELECT source || '/' || doc_id || '.txt' AS object_key, chunk, text, 256 AS dimensions FROM chunked""",
)
def _replaced(t: Tables) -> DataFrame:
    """A stored snapshot of older texts; half of the objects are indexed anew and replace their chunks in place."""
    path = run_folder(t.spark, "snapshot")
    old = t.documents.withColumn("text", F.concat("text", F.lit(" old")))
    # Chunks are dealt to their buckets before they get their vectors.
    chunked = lambda documents: document_index(t, documents=documents, embed=lambda rows, text: rows)
    embedded = lambda rows: hashing(256)(rows, "text")
    snapshots.write(chunked(old), path, "object_key", finish=embedded)
    snapshots.update(t.spark, path, chunked(t.documents.filter("doc_id % 2 = 0")), "groups", finish=embedded)
    return snapshots.read(t.spark, path).select("object_key", "chunk", "text", F.size("embedding").alias("dimensions"))


def benchmark_questions(t: Tables) -> DataFrame:
    """Every benchmark passage asked as a question."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@BOOK.add("g05_retrieved_chunks")
def _retrieved(t: Tables) -> DataFrame:
    found = retrieve(document_index(t), benchmark_questions(t), hashing(256))
    return found.select("query_id", "id", "rank", "final_rank", F.round("relevance_score", 6).alias("relevance_score"))


@BOOK.add("g05_evidence_context")
def _context(t: Tables) -> DataFrame:
    return evidence_context(retrieve(document_index(t), benchmark_questions(t), hashing(256)))
