"""Text clean-up, splitting and naming."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from saltmarsh.functions.values import let, rest

# Fixed value: the characters that count as white space (Unicode-aware).
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Runs of white space other than one lone blank, which needs no replacing.
_UNEVEN_SPACE = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"

# Phrases that mark a paragraph as boilerplate.
BOILERPLATE_MARKERS = ("baca juga:", "advertisement", "sponsored", "ikuti kami")

# Fixed value: words that carry no topic.
TOPIC_NOISE = r"\b(news|berita|hari ini|today|terbaru|latest)\b"

DEFAULT_TOPIC = "General News"
PAGE_MARKER = r"===== PAGE (\d+) ====="
TOKEN = r"[a-z0-9][a-z0-9-]*"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARACTERS))


def squash(text: Column) -> Column:
    """Collapse every white-space run to one blank and strip the ends."""
    return F.btrim(F.regexp_replace(text, _UNEVEN_SPACE, " "))


def blank_to_null(text: Column) -> Column:
    """Null for null, empty or white-space-only text; otherwise the text unchanged."""
    return F.when(strip(text) != "", text)


def tidy_extracted(text: Column) -> Column:
    """Clean text before it is cut: blanks and tabs collapsed, at most one empty line."""
    narrowed = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    return strip(F.regexp_replace(narrowed, r"\n{3,}", "\n\n"))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of raw windows of ``size`` characters, each starting ``size - overlap`` later.

    The text is cut once into blocks of one step each; a window is its block plus
    the head of the next one. That reads the text once, where taking substrings
    would walk from the start of the text for every window.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("overlap must lie between 0 and half of the size")
    blocks = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))

    def join_heads(cut: Column) -> Column:
        return F.zip_with(
            cut,
            rest(cut),
            lambda block, after: F.concat(block, F.coalesce(F.substring(after, 1, overlap), F.lit(""))),
        )

    return let(blocks, join_heads)


def chunks(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """Array of stripped, non-blank windows over the whole text."""
    stripped = F.transform(windows(text, size, overlap), strip)
    return F.filter(stripped, lambda piece: piece != "")


def article_windows(text: Column, size: int = 4500, overlap: int = 500) -> Column:
    """Array of ``{chunk, text}`` covering the whole article.

    A window that would only repeat the tail of a window that already reached
    the end is left out; blank windows are dropped but keep their number.
    """
    step = size - overlap

    def cover(whole: Column) -> Column:
        # Windows start while the one before has not reached the end.
        needed = F.greatest(F.lit(1), F.floor((F.length(whole) - size) / step) + 2).cast("int")
        numbered = F.transform(
            windows(whole, size, overlap), lambda w, i: F.struct(i.alias("chunk"), strip(w).alias("text"))
        )
        return F.filter(F.slice(numbered, F.lit(1), needed), lambda w: w["text"] != "")

    return let(text, cover)


def marked_pages(text: Column) -> Column:
    """Array of ``{page, text}`` from text with page markers; text before the first is ignored."""
    numbers = F.regexp_extract_all(text, F.lit(PAGE_MARKER), F.lit(1))
    bodies = rest(F.split(text, PAGE_MARKER))
    pages = F.zip_with(
        numbers,
        bodies,
        lambda number, body: F.struct(
            number.cast("int").alias("page"), tidy_extracted(body).alias("text")
        ),
    )
    return F.filter(pages, lambda page: page["text"] != "")


def clean_paragraphs(paragraphs: Column) -> Column:
    """Squash paragraphs, drop boilerplate and repeats, join by an empty line."""
    squashed = F.transform(paragraphs, squash)

    def boilerplate(lowered: Column) -> Column:
        # Plain searches; one pattern with alternatives is several times slower.
        found = F.lit(False)
        for marker in BOILERPLATE_MARKERS:
            found = found | F.contains(lowered, F.lit(marker))
        return found

    def keep(paragraph: Column) -> Column:
        return (paragraph != "") & ~let(F.lower(paragraph), boilerplate)

    return F.array_join(F.array_distinct(F.filter(squashed, keep)), "\n\n")


def distinct_paragraphs(paragraphs: Column) -> Column:
    """As :func:`clean_paragraphs` but keeping boilerplate."""
    squashed = F.transform(paragraphs, squash)
    return F.array_join(F.array_distinct(F.filter(squashed, lambda p: p != "")), "\n\n")


def clean_answer(text: Column) -> Column:
    """Remove answer markup: escaped line ends, source blocks and lines, star rules."""
    out = F.replace(text, F.lit("\\r\\n"), F.lit("\n"))
    out = F.replace(out, F.lit("\\n"), F.lit("\n"))
    out = F.replace(out, F.lit("\r\n"), F.lit("\n"))
    for pattern in ANSWER_MARKUP:
        out = F.regexp_replace(out, pattern, "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


# Markup removed from answers, in this order.
ANSWER_MARKUP = (
    r"(?is)>{2,}\s*sources?\s*>{2,}.*?(?:<{2,}|$)",
    r"(?im)^\s*>{2,}\s*sources?\s*>{2,}\s*$",
    r"(?im)^\s*<{2,}\s*$",
    r"(?im)^\s*\[?sources?\]?\s*:?\s*$",
    r"(?m)^\s*[*]{3,}\s*$",
)


def unwrap_answer(text: Column) -> Column:
    """The ``answer`` member when the text is a JSON object that has one, else the text."""
    return F.coalesce(F.get_json_object(text, "$.answer"), text)


def slug(text: Column, default: str = "unknown_source") -> Column:
    joined = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def title_case(text: Column) -> Column:
    """Capital at the start of every run of letters, also after digits and punctuation."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def topic_name(query: Column) -> Column:
    words = F.btrim(squash(F.regexp_replace(F.coalesce(query, F.lit("")), "(?iU)" + TOPIC_NOISE, " ")), F.lit(" ,.-"))
    return F.coalesce(F.nullif(title_case(words), F.lit("")), F.lit(DEFAULT_TOPIC))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)))


def terms(text: Column) -> Column:
    """Distinct lower-case words longer than two characters."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    return F.filter(words, lambda word: F.length(word) > 2)
