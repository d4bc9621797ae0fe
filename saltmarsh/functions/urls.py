"""Identities derived from urls and object keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from saltmarsh.functions.text import slug

# Content types by file extension.
CONTENT_TYPES = {
    "csv": "text/csv",
    "html": "text/html",
    "json": "application/json",
    "md": "text/markdown",
    "pdf": "application/pdf",
    "txt": "text/plain",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# Fixed value: article number inside a url.
ARTICLE_NUMBER = r"(?:^|/)d-(\d+)(?:/|$|-)"


def host(url: Column) -> Column:
    """Lower-case host without port; null when there is none."""
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.lower(authority), F.lit(""))


def in_domain(url: Column, domain: str) -> Column:
    name = host(url)
    return F.coalesce((name == domain) | F.endswith(name, F.lit("." + domain)), F.lit(False))


def article_file(url: Column) -> Column:
    number = F.regexp_extract(url, ARTICLE_NUMBER, 1)
    stem = F.when(number != "", F.concat(F.lit("d-"), number)).otherwise(F.sha2(url, 256))
    return F.concat(stem, F.lit(".json"))


def object_key(source: Column, url: Column) -> Column:
    """The one key under which an article is stored and indexed."""
    return F.concat(
        slug(F.coalesce(source, F.lit("unknown_source"))),
        F.lit("/"),
        article_file(F.coalesce(url, F.lit(""))),
    )


def session_object_key(source: Column, url: Column, session: Column, collected: Column) -> Column:
    """Key below a dated session folder, or the plain key when there is no session."""
    plain = object_key(source, url)
    name = F.nullif(F.btrim(session), F.lit(""))
    dated = F.concat(
        F.lit("computer_use/"), F.date_format(collected, "yyyy/MM/dd"), F.lit("/"), name, F.lit("/"), plain
    )
    return F.coalesce(dated, plain)


def artifact_id(url: Column) -> Column:
    return F.sha2(F.coalesce(url, F.lit("")), 256)


def article_id(url: Column) -> Column:
    dashed = F.btrim(F.regexp_replace(url, "[^a-zA-Z0-9]+", "-"), F.lit("-"))
    return F.substring(dashed, 1, 100)


def file_name(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def file_stem(key: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(file_name(key), r"(?<=.)\.[^.]*$", "")


def extension(key: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(key), r".\.([^.]*)$", 1))


def content_type(key: Column) -> Column:
    table = F.create_map(*[F.lit(part) for pair in CONTENT_TYPES.items() for part in pair])
    return F.coalesce(table[extension(key)], F.lit(DEFAULT_CONTENT_TYPE))
