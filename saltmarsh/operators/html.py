"""Article extraction from HTML: paragraphs from the tags in a row, single fields by pattern."""

from __future__ import annotations

import html as _html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from saltmarsh.functions import text as tx
from saltmarsh.functions.values import filled
from saltmarsh.operators.markup import page_bodies

DEFAULT_CATEGORY = "Finance"
LOGIN_TEXT = "log in|login|sign in|authentication required|masuk"
LOGIN_URL = "login|signin|auth|account"
# A control character that cannot occur in a page parts the fields of an article.
_PART = "\x01"


# The common character entities, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "\xa9"), ("&middot;", "\xb7"))


def _decode_rest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda text: _html.unescape(text) if isinstance(text, str) else None)


def decoded(text: Column) -> Column:
    """Character entities decoded, the common ones inside the JVM.

    Only texts that hold another one go through Python; for all others it gets null.
    """
    other = F.regexp_replace(text, "&(?:lt|gt|quot|#39|nbsp|copy|middot|amp);", "").contains("&")
    plain = text
    for entity, char in (*ENTITIES, ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.coalesce(F.pandas_udf(_decode_rest, T.StringType())(F.when(other, text)), plain)


def plain_text(markup: Column) -> Column:
    """Text between tags; line-break tags separate words."""
    return F.regexp_replace(F.regexp_replace(markup, r"(?i)<br\s*/?>", " "), r"(?s)<[^>]*>", "")


def first_element(page: Column, *patterns: str) -> Column:
    """First non-blank inner text over several patterns with one group each."""
    return F.coalesce(*[filled(tx.squash(plain_text(F.regexp_extract(page, p, 1)))) for p in patterns])


# Where each field of an article may stand; attributes in either order and quotes.
TITLE = (
    r"(?is)<h1\b[^>]*>(.*?)</h1\s*>",
    r"(?is)<meta\b(?=[^>]*property=[\"']og:title[\"'])[^>]*content=[\"']([^\"'>]*)[\"']",
)
AUTHOR = (
    r"(?is)<[a-z]+\b[^>]*rel=\"author\"[^>]*>(.*?)</",
    r"(?is)<[a-z]+\b[^>]*class=\"[^\"]*author[^\"]*\"[^>]*>(.*?)</",
)
PUBLISHED = (
    r"(?is)<time\b[^>]*>(.*?)</time",
    r"(?is)<meta\b[^>]*property=\"article:published_time\"[^>]*content=\"([^\"]*)\"",
)
CATEGORY = (
    r"(?is)<[a-z]+\b[^>]*rel=\"category\"[^>]*>(.*?)</",
    r"(?is)<[a-z]+\b[^>]*class=\"[^\"]*category[^\"]*\"[^>]*>(.*?)</",
)
def extract_articles(pages: DataFrame, html: str = "html", fallback_title: str | None = None) -> DataFrame:
    """Title, category, author, time and content of every page that has title and content.

    Content is every paragraph inside article elements, then inside main elements,
    then inside elements with that role, each text once; without any, the whole
    text of the first body.
    """
    page = F.col(html)
    fallback = F.col(fallback_title) if fallback_title else F.lit(None).cast("string")
    keep = [c for c in pages.columns if c != html]

    content = F.coalesce(filled(tx.clean_paragraphs(F.col("_bodies.paragraphs"))), filled(tx.squash(F.col("_bodies.body"))))
    article = F.struct(
        F.coalesce(first_element(page, *TITLE), fallback).alias("title"),
        F.coalesce(first_element(page, *CATEGORY), F.lit(DEFAULT_CATEGORY)).alias("category"),
        first_element(page, *AUTHOR).alias("author"),
        first_element(page, *PUBLISHED).alias("published_at"),
        content.alias("content"),
    )
    # Incomplete articles are dropped inside the generator: a filter would be
    # pushed below the extraction and run all of it a second time.
    complete = F.filter(F.array(article), lambda a: a["title"].isNotNull() & a["content"].isNotNull())
    found = pages.withColumn("_bodies", page_bodies(page)).select(*keep, F.inline(complete))
    # The fields of a page pass Python as one text, and only if one of them needs it.
    names = ("title", "author", "published_at", "category", "content")
    shown = [F.when(F.col(n).isNotNull(), F.concat(F.lit("+"), F.col(n))).otherwise(F.lit("-")) for n in names]
    parts = found.withColumn("_fields", F.split(decoded(F.concat_ws(_PART, *shown)), _PART))
    part = [F.get("_fields", F.lit(i)) for i in range(len(names))]
    return parts.select(*keep, *[F.when(F.startswith(p, F.lit("+")), F.substr(p, F.lit(2))).alias(n) for p, n in zip(part, names)])


def is_login_page(url: Column, page: Column) -> Column:
    """Login wording in the text and a login word in the url."""
    text = F.lower(plain_text(page))
    return F.coalesce(text.rlike(LOGIN_TEXT) & F.lower(url).rlike(LOGIN_URL), F.lit(False))


def page_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per link with text: position, title, absolute address."""
    pattern = r"(?is)(<a\b[^>]*href=\"[^\"]*\"[^>]*>.*?</a\s*>)"
    keep = [c for c in pages.columns if c != html]
    links = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("position", "_a"))
    href = F.regexp_extract("_a", r"(?is)href=\"([^\"]*)\"", 1)
    root = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    absolute = (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.concat(root, F.lit("/"))), href))
    )
    return links.select(
        *keep, "position", tx.squash(plain_text(F.col("_a"))).alias("title"), href.alias("href"), absolute.alias("link")
    )


def candidate_links(links: DataFrame, terms: list[str]) -> DataFrame:
    """Links to other http pages whose title shares a whole word with the search."""
    usable = ~F.col("href").rlike("^(#|mailto:|javascript:)") & F.col("link").rlike("^https?://")
    words = F.split(F.lower("title"), " ")
    shared = F.arrays_overlap(words, F.array(*[F.lit(t) for t in terms]))
    return links.filter((F.col("title") != "") & (F.col("href") != "") & usable & shared)
