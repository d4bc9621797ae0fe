"""Question understanding over conversations and titles over pages and documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from saltmarsh.catalog.base import Book, Tables
from saltmarsh.catalog.texts import sql_squash, sql_strip
from saltmarsh.functions import questions as qs
from saltmarsh.operators.html import first_element, TITLE
from saltmarsh.operators.ranking import understand

BOOK = Book()

# Questions with something to recognise, chosen by turn, each ending in the table's own text.
PREFIXES = (
    "Berita terbaru harga emas hari ini? ",
    "Kenapa penjualan product b turun di Q3 2024, BCA ",
    "why is the bitcoin prize up? ",
    "Ramalan pendapatan next 7 days ",
    "Laporan contract invoice south region ",
    "Suku bunga Bank Indonesia dan dampak rupiah ",
    "saham BBRI market report ",
    "",
)
SUFFIX = " application context: dashboard"


def questions(t: Tables) -> DataFrame:
    prefix = F.lit("")
    for i, text in enumerate(PREFIXES):
        prefix = F.when(F.col("turn") == i, text).otherwise(prefix)
    suffix = F.when(F.col("role") == "assistant", F.lit(SUFFIX)).otherwise("")
    return t.conversations.select("conv_id", "turn", F.concat(prefix, "text", suffix).alias("text"))


_CASES = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(PREFIXES))
Q = f"q AS (SELECT conv_id, turn, (CASE turn {_CASES} ELSE '' END) || text || CASE WHEN role = 'assistant' THEN '{SUFFIX}' ELSE '' END AS text FROM conversations)"


def _sql_normal() -> str:
    out = sql_squash("lower(text)")
    for source, target in qs.SYNONYMS.items():
        out = f"replace({out}, '{source}', '{target}')"
    return out


_STOP = ", ".join(f"'{w}'" for w in qs.STOP_WORDS)
_TOPICS = ", ".join(f"'{w}'" for w in qs.TOPIC_TERMS)
N = f"""{Q}, n AS (SELECT conv_id, turn, {_sql_normal()} AS normalized FROM q),
  tok AS (SELECT conv_id, turn, unnest(regexp_extract_all(normalized, '[a-z0-9][a-z0-9-]*')) AS w,
            generate_subscripts(regexp_extract_all(normalized, '[a-z0-9][a-z0-9-]*'), 1) AS i FROM n),
  kw AS (SELECT conv_id, turn, w, min(i) AS i FROM tok WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY 1, 2, 3)"""


@BOOK.add(
    "t16_query_keywords",
    f"""WITH {N} SELECT n.conv_id, n.turn, normalized, coalesce(string_agg(w, ' ' ORDER BY i), '') AS keywords
        FROM n LEFT JOIN kw ON n.conv_id = kw.conv_id AND n.turn = kw.turn GROUP BY 1, 2, 3""",
)
def _keywords(t: Tables) -> DataFrame:
    return understand(questions(t)).select("conv_id", "turn", "normalized", F.array_join("keywords", " ").alias("keywords"))


_ENTITY_SQL = qs.ENTITY.replace("(?i)", "(?i)")


@BOOK.add(
    "t17_entities_and_topics",
    f"""WITH {N}, ent AS (SELECT conv_id, turn, e, min(i) AS i FROM (SELECT conv_id, turn, unnest(regexp_extract_all(normalized, '{_ENTITY_SQL}', 1)) AS e,
               generate_subscripts(regexp_extract_all(normalized, '{_ENTITY_SQL}', 1), 1) AS i FROM n) GROUP BY 1, 2, 3),
          es AS (SELECT conv_id, turn, string_agg(e, '|' ORDER BY i) AS entities FROM ent GROUP BY 1, 2),
          ts AS (SELECT conv_id, turn, string_agg(w, '|' ORDER BY i) AS topics FROM kw WHERE w IN ({_TOPICS}) GROUP BY 1, 2)
        SELECT n.conv_id, n.turn, coalesce(entities, '') AS entities, coalesce(topics, '') AS topics
        FROM n LEFT JOIN es ON n.conv_id = es.conv_id AND n.turn = es.turn LEFT JOIN ts ON n.conv_id = ts.conv_id AND n.turn = ts.turn""",
)
def _entities(t: Tables) -> DataFrame:
    known = understand(questions(t))
    return known.select("conv_id", "turn", F.array_join("entities", "|").alias("entities"), F.array_join("topics", "|").alias("topics"))


@BOOK.add(
    "t18_intent_and_freshness",
    f"""WITH {N} SELECT conv_id, turn, CASE WHEN regexp_matches(normalized, '{qs.NEWS_INTENT}') THEN 'NEWS'
          WHEN regexp_matches(normalized, '{qs.FORECAST_INTENT}') THEN 'FORECAST' WHEN regexp_matches(normalized, '{qs.DOCUMENT_INTENT}') THEN 'DOCUMENT'
          ELSE 'INTERNAL_KNOWLEDGE' END AS intent, CASE WHEN regexp_matches(normalized, '{qs.RECENT}') THEN 'recent' ELSE 'historical' END AS freshness FROM n""",
)
def _intent(t: Tables) -> DataFrame:
    return understand(questions(t)).select("conv_id", "turn", "intent", "freshness")


def _m(pattern: str) -> str:
    return f"regexp_matches(text, '(?i){pattern}')"


def _in_one_line(rule: str) -> str:
    """The two lookaheads of a rule, tried on every line."""
    first, second = re.findall(r"\(\?=\.\*(.*?\\b)\)", rule)
    tests = " AND ".join(f"regexp_matches(line, '(?i){p}')" for p in (first, second))
    return f"len([line FOR line IN string_split(replace(text, chr(13), chr(10)), chr(10)) IF {tests}]) > 0"


_FLAG_SQL = f"""WITH {Q}, f AS (SELECT conv_id, turn, text, {_m(qs.FLAG_MARKET)} AS market, {_m(qs.FLAG_TICKER)} AS ticker, {_m(qs.FLAG_MARKET_CAUSE)} AS cause,
    {_m(qs.FLAG_PRICE_NOW)} AS now, {_in_one_line(qs.FLAG_MARKET_NEWS)} AS moved, {_m(qs.FLAG_NEWS)} AS newsy,
    {_m(qs.FLAG_FORECAST)} AS forecast, {_m(qs.FLAG_DOCUMENT)} AS document, {_m(qs.FLAG_BUSINESS)} AS business FROM q),
  g AS (SELECT *, ticker OR (market AND cause) AS current, (market OR ticker) AND now AS priced FROM f),
  h AS (SELECT *, current OR newsy OR moved AS news FROM g)
SELECT conv_id, turn, NOT current AND NOT priced AND (business OR document OR (NOT news AND NOT forecast)) AS rag, forecast, news, document FROM h"""


@BOOK.add("t19_routing_flags", _FLAG_SQL)
def _flags(t: Tables) -> DataFrame:
    flagged = questions(t).select("conv_id", "turn", qs.routing_flags(F.col("text")).alias("flags"))
    return flagged.select("conv_id", "turn", "flags.*")


@BOOK.add(
    "t19_research_flags",
    f"""WITH {Q}, f AS (SELECT conv_id, turn, regexp_matches(lower(text), '{qs.RESEARCH_CURRENT}') AS c, regexp_matches(lower(text), '{qs.RESEARCH_DOCUMENT}') AS d,
          regexp_matches(lower(text), '{qs.RESEARCH_FORECAST}') AS f FROM q)
        SELECT conv_id, turn, CASE WHEN d AND NOT c THEN 'document_question' WHEN c THEN 'current_market_analysis' ELSE 'general_question' END AS intent,
          c AND NOT d AS requires_external_research, f AS requires_forecast FROM f""",
)
def _research(t: Tables) -> DataFrame:
    return questions(t).select("conv_id", "turn", *[c.alias(n) for n, c in qs.research_flags(F.col("text")).items()])


_CLEAN = (
    "trim(" + sql_squash(
        "regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\s*application context\\s*:.*$', '', 'g'), "
        "'(?i)^\\s*(why did|why has|why is|kenapa|mengapa)\\s+', ''), '(?i)\\bprize\\b', 'price', 'g')"
    ) + ", ' ?.!' || chr(9) || chr(13) || chr(10))"
)


@BOOK.add("t20_clean_questions", f"WITH {Q} SELECT conv_id, turn, {_CLEAN} AS question FROM q")
def _clean(t: Tables) -> DataFrame:
    return questions(t).select("conv_id", "turn", qs.clean_question(F.col("text")).alias("question"))


def _sql_variants() -> str:
    def listing(patterns: tuple[str, ...]) -> str:
        return "[c, " + ", ".join("replace('" + p + "', '{q}', c)" for p in patterns) + "]"

    whens = []
    for words, patterns in qs.VARIANTS:
        test = " OR ".join(f"contains(lower(c), '{w}')" for w in words)
        if "rupiah" in words:
            test += " OR lower(c) = 'bi'"
        whens.append(f"WHEN {test} THEN {listing(patterns)}")
    return "CASE " + " ".join(whens) + f" ELSE {listing(qs.DEFAULT_VARIANTS)} END"


@BOOK.add(
    "t21_search_variants",
    f"""WITH {Q}, c AS (SELECT conv_id, turn, {_CLEAN} AS c FROM q), v AS (SELECT conv_id, turn, {_sql_variants()} AS vs FROM c),
          u AS (SELECT conv_id, turn, unnest(vs) AS variant, generate_subscripts(vs, 1) AS i FROM v),
          d AS (SELECT conv_id, turn, variant, min(i) AS i FROM u GROUP BY 1, 2, 3)
        SELECT conv_id, turn, variant, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS position FROM d
        QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) <= 4""",
)
def _variants(t: Tables) -> DataFrame:
    return questions(t).select("conv_id", "turn", F.posexplode(qs.search_variants(F.col("text"))).alias("position", "variant"))


_EXPANSION = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in qs.KEYWORD_EXPANSIONS.items()) + " ELSE '' END"


@BOOK.add(
    "t21_expanded_queries",
    f"""WITH {N}, x AS (SELECT conv_id, turn, string_agg({_EXPANSION}, ' ' ORDER BY i) AS extra FROM kw GROUP BY 1, 2)
        SELECT n.conv_id, n.turn, {sql_strip("normalized || coalesce(' ' || extra, '')")} AS expanded
        FROM n LEFT JOIN x ON n.conv_id = x.conv_id AND n.turn = x.turn""",
)
def _expanded(t: Tables) -> DataFrame:
    return understand(questions(t)).select("conv_id", "turn", "expanded")


TITLE_QUESTION = "the bank and silver price with er"


def _sql_named(column: str, words: list[str]) -> str:
    return " + ".join(f"CAST(contains({column}, '{w}') AS INTEGER)" for w in words)


def page_titles(t: Tables) -> DataFrame:
    extra = F.when(F.pmod("page_id", F.lit(3)) == 0, "Harga silver ").when(F.pmod("page_id", F.lit(3)) == 1, "Emas Gold ").otherwise("Bank ")
    return t.pages.select("page_id", "url", F.concat(extra, first_element(F.col("html"), *TITLE)).alias("title"))


SQL_TITLES = f"""titles AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'Harga silver ' WHEN 1 THEN 'Emas Gold ' ELSE 'Bank ' END ||
  {sql_squash("regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '(?i)<br\\s*/?>', ' ', 'g'), '(?s)<[^>]*>', '', 'g')")} AS title FROM pages)"""


@BOOK.add(
    "t22_title_scores",
    f"""WITH {SQL_TITLES}, s AS (SELECT page_id, title, {_sql_named('lower(title)', qs.question_terms(TITLE_QUESTION))} AS score,
          ({_sql_named('lower(title)', list(qs.MARKET_WORDS))}) > 0 AS market, ({_sql_named('lower(title)', list(qs.COMMODITY_WORDS))}) > 0 AS commodity FROM titles)
        SELECT page_id, title, score FROM s WHERE commodity AND (score > 0 OR market)""",
)
def _titles(t: Tables) -> DataFrame:
    scored = page_titles(t).select("page_id", "title", qs.title_score(F.col("title"), TITLE_QUESTION).alias("score"))
    return scored.filter(F.col("score").isNotNull())


@BOOK.add(
    "o05_ranked_candidates",
    f"""WITH {SQL_TITLES}, s AS (SELECT page_id, title, url, {_sql_named('lower(title)', qs.question_terms(TITLE_QUESTION))} AS score,
          ({_sql_named('lower(title)', list(qs.MARKET_WORDS))}) > 0 AS market, ({_sql_named('lower(title)', list(qs.COMMODITY_WORDS))}) > 0 AS commodity FROM titles)
        SELECT min(page_id) AS page_id, title, score FROM s WHERE commodity AND (score > 0 OR market) GROUP BY title, url, score
        ORDER BY score DESC, title DESC, url DESC LIMIT 10""",
)
def _ranked(t: Tables) -> DataFrame:
    """Twice the five requested candidates, best score first; pages found twice count once."""
    titles = page_titles(t)
    scored = titles.union(titles).withColumn("score", qs.title_score(F.col("title"), TITLE_QUESTION))
    known = scored.filter(F.col("score").isNotNull()).groupBy("title", "url", "score").agg(F.min("page_id").alias("page_id"))
    ranked = known.orderBy(F.desc("score"), F.desc("title"), F.desc("url"))
    return ranked.limit(2 * 5).select("page_id", "title", "score")


RELEVANCE_QUESTION = "the and with from this that"


@BOOK.add(
    "t23_article_relevance",
    f"""SELECT doc_id, round(least(1.0, ({_sql_named("lower(source || ' ' || text)", qs.question_terms(RELEVANCE_QUESTION))}) /
        CAST({max(1, min(len(qs.question_terms(RELEVANCE_QUESTION)), 4))} AS DOUBLE)), 3) AS relevance_score FROM documents""",
)
def _relevance(t: Tables) -> DataFrame:
    score = qs.article_relevance(F.col("source"), F.col("text"), RELEVANCE_QUESTION)
    return t.documents.select("doc_id", score.alias("relevance_score"))
