"""Understanding of user questions: keywords, entities, intent, search variants."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from saltmarsh.functions.text import squash, strip, tokens
from saltmarsh.functions.values import let

# Domain synonyms, replaced longest first.
SYNONYMS = {
    "berita terbaru": "latest news",
    "pendapatan": "revenue",
    "suku bunga": "interest rate",
    "penjualan": "sales",
    "prediksi": "forecast",
    "ramalan": "forecast",
    "berita": "news",
    "dampak": "impact",
    "bca": "bbca",
}

# Words that are never keywords.
STOP_WORDS = (
    "apa", "bagaimana", "kenapa", "mengapa", "yang", "dan", "atau", "kita", "dari", "untuk",
    "terhadap", "the", "our", "what", "how", "why", "about", "does", "this", "that",
)

# Keywords that name a topic.
TOPIC_TERMS = (
    "revenue", "sales", "forecast", "interest", "rate", "inflation", "news", "market", "economy",
    "regulation", "inventory", "contract", "report", "bbca",
)

# Patterns over the normalised question.
ENTITY = r"(?i)\b(product\s+[a-z]|q[1-4]|20\d{2}|bca|bank indonesia|south|north|selatan|utara)\b"
NEWS_INTENT = "news|market|economy|economic|latest|current|recent|today|terbaru|terkini|hari ini"
FORECAST_INTENT = r"forecast|prediction|future|next month|next \d+ days|bulan depan|prediksi"
DOCUMENT_INTENT = "invoice|contract|agreement|document|report|laporan|dokumen"
RECENT = "latest|current|recent|today|terbaru|terkini|hari ini|minggu ini"

# Search words added for a keyword.
KEYWORD_EXPANSIONS = {
    "interest": "rate suku bunga biaya pinjaman",
    "revenue": "pendapatan omzet",
    "sales": "penjualan transaksi",
    "forecast": "prediksi proyeksi",
}

# Case-insensitive patterns of the routing flags.
FLAG_NEWS = (
    "news|berita|market|pasar|ekonomi|economic|regulation|regulasi|competitor|kompetitor|current|"
    "terbaru|terkini|today|hari ini|recent|industry|industri|external|eksternal"
)
# Both in one line, in any order.
FLAG_MARKET_NEWS = (
    r"(?=.*\b(?:bitcoin|crypto|cryptocurrency|btc|silver|perak|gold|emas|ihsg|saham|rupiah|minyak|oil|coal|batu bara)\b)"
    r"(?=.*\b(?:price|prize|harga|drop|fall|fell|declin|turun|naik|rise|rally|volatil|volatile)\b)"
)
FLAG_FORECAST = (
    r"forecast|prediction|prediksi|future|masa depan|next\s+(?:7|14|30)\s+days?|next month|"
    r"bulan depan|expected|projected|proyeksi|demand"
)
FLAG_BUSINESS = (
    "revenue|pendapatan|sales|penjualan|order|pesanan|product|produk|customer|pelanggan|region|"
    "wilayah|business|bisnis|declin|turun|naik|performance|kinerja|inventory|inventor"
)
FLAG_DOCUMENT = (
    "invoice|faktur|receipt|kuitansi|agreement|kontrak|letter|surat|document|dokumen|report|"
    "laporan|internal"
)
FLAG_MARKET = (
    r"bitcoin|crypto|cryptocurrency|btc|silver|perak|gold|emas|ihsg|saham|rupiah|minyak|oil|coal|"
    r"batu bara|bi rate|inflasi|usd\s*/?\s*idr|dolar"
)
FLAG_MARKET_CAUSE = "kenapa|mengapa|why|turun|naik|drop|fall|fell|declin|rise|rally|harga|price|market|pasar"
FLAG_TICKER = r"\b(?:BBRI|BBCA|BMRI|BBNI|ASII|TLKM|GOTO|ANTM|MDKA|UNTR)\b"
FLAG_PRICE_NOW = "harga|price|sekarang|current|today|hari ini|terbaru|terkini"

# Patterns of the research classifier.
RESEARCH_CURRENT = "bitcoin|crypto|btc|harga|turun|naik|berita|terbaru|hari ini|market|pasar"
RESEARCH_FORECAST = "forecast|prediksi|proyeksi|masa depan"
RESEARCH_DOCUMENT = "laporan|report|dokumen|invoice|revenue"

# Search variants by subject, first match wins; {q} is the question.
VARIANTS = (
    (("ihsg", "saham", "bbca"), ("indeks saham Indonesia", "bursa saham Indonesia", "{q} hari ini")),
    (("emas", "gold", "xau"), ("emas Antam", "harga emas dunia", "logam mulia Indonesia")),
    (
        ("perak", "silver"),
        (
            "harga perak turun",
            "silver price drop",
            "berita harga perak",
            "pasar logam mulia perak Indonesia",
        ),
    ),
    (
        ("rupiah", "bank indonesia"),
        ("nilai tukar rupiah", "kebijakan Bank Indonesia", "kurs rupiah hari ini"),
    ),
    (
        ("bitcoin", "crypto"),
        ("harga Bitcoin turun", "berita Bitcoin terbaru", "aset kripto Indonesia", "pasar kripto"),
    ),
)
DEFAULT_VARIANTS = ("berita {q}", "ekonomi {q}", "{q} terbaru")
MAX_VARIANTS = 4

# Title words of the candidate filter.
MARKET_WORDS = (
    "saham", "ihsg", "bursa", "rupiah", "emas", "perak", "silver", "investor", "bank", "pasar", "ekonomi",
)
COMMODITIES = ("silver", "perak", "emas", "gold", "xau")
COMMODITY_WORDS = ("silver", "perak", "emas", "gold", "logam mulia")


def normalise(question: Column) -> Column:
    """Lower case, collapsed white space, synonyms folded."""
    out = squash(F.lower(question))
    for source, target in SYNONYMS.items():
        out = F.replace(out, F.lit(source), F.lit(target))
    return out


def keywords(normalised: Column) -> Column:
    stop = F.array(*[F.lit(word) for word in STOP_WORDS])
    return F.filter(
        tokens(normalised), lambda word: (F.length(word) > 2) & ~F.array_contains(stop, word)
    )


def entities(normalised: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normalised, F.lit(ENTITY), F.lit(1)))


def topics(words: Column) -> Column:
    return F.array_intersect(words, F.array(*[F.lit(term) for term in TOPIC_TERMS]))


def intent(normalised: Column) -> Column:
    return (
        F.when(normalised.rlike(NEWS_INTENT), "NEWS")
        .when(normalised.rlike(FORECAST_INTENT), "FORECAST")
        .when(normalised.rlike(DOCUMENT_INTENT), "DOCUMENT")
        .otherwise("INTERNAL_KNOWLEDGE")
    )


def freshness(normalised: Column) -> Column:
    return F.when(normalised.rlike(RECENT), "recent").otherwise("historical")


def expanded(normalised: Column, words: Column) -> Column:
    """The question followed by the search words of its keywords."""
    table = F.create_map(*[F.lit(part) for pair in KEYWORD_EXPANSIONS.items() for part in pair])
    extra = F.transform(words, lambda word: F.coalesce(table[word], F.lit("")))
    return strip(F.array_join(F.concat(F.array(normalised), extra), " "))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def _line_has(text: Column, lookaheads: str) -> Column:
    """Whether some line meets all lookaheads.

    They look ahead from the start of each line: what holds from a later place in
    the line holds from its start, and a trial at every place would take a time
    that grows with the square of the line.
    """
    return text.rlike("(?im)^" + lookaheads)


def routing_flags(question: Column) -> Column:
    """Struct of rag, forecast, news and document; every pattern runs once."""
    facts = F.struct(
        _has(question, FLAG_MARKET).alias("market"),
        _has(question, FLAG_TICKER).alias("ticker"),
        _has(question, FLAG_MARKET_CAUSE).alias("cause"),
        _has(question, FLAG_PRICE_NOW).alias("priced"),
        _line_has(question, FLAG_MARKET_NEWS).alias("moved"),
        _has(question, FLAG_NEWS).alias("news"),
        _has(question, FLAG_FORECAST).alias("forecast"),
        _has(question, FLAG_DOCUMENT).alias("document"),
        _has(question, FLAG_BUSINESS).alias("business"),
    )

    def decide(f: Column) -> Column:
        current = f["ticker"] | (f["market"] & f["cause"])
        priced = (f["market"] | f["ticker"]) & f["priced"]
        news = current | f["news"] | f["moved"]
        internal = f["business"] | f["document"] | (~news & ~f["forecast"])
        return F.struct(
            (~current & ~priced & internal).alias("rag"),
            f["forecast"].alias("forecast"),
            news.alias("news"),
            f["document"].alias("document"),
        )

    return let(facts, decide)


def research_flags(question: Column) -> dict[str, Column]:
    lowered = F.lower(question)
    current = lowered.rlike(RESEARCH_CURRENT)
    document = lowered.rlike(RESEARCH_DOCUMENT)
    return {
        "intent": F.when(document & ~current, "document_question")
        .when(current, "current_market_analysis")
        .otherwise("general_question"),
        "requires_external_research": current & ~document,
        "requires_forecast": lowered.rlike(RESEARCH_FORECAST),
    }


def clean_question(question: Column) -> Column:
    """Drop trailing application context and leading why-words, fix a common slip."""
    out = F.coalesce(question, F.lit(""))
    out = F.regexp_replace(out, r"(?id)\s*application context\s*:.*$", "")
    out = F.regexp_replace(out, r"(?i)^\s*(why did|why has|why is|kenapa|mengapa)\s+", "")
    out = F.regexp_replace(out, r"(?iU)\bprize\b", "price")
    return F.btrim(squash(out), F.lit(" ?.!\t\r\n"))


def search_variants(question: Column) -> Column:
    """Up to four ordered distinct searches for one question."""

    def choose(both: Column) -> Column:
        cleaned, lowered = both["cleaned"], both["lowered"]

        def variants(patterns: tuple[str, ...]) -> Column:
            filled = [F.replace(F.lit(p), F.lit("{q}"), cleaned) if "{q}" in p else F.lit(p) for p in patterns]
            return F.array(cleaned, *filled)

        chosen = variants(DEFAULT_VARIANTS)
        for words, patterns in reversed(VARIANTS):
            named = _has_any(lowered, words)
            if "rupiah" in words:
                named = named | (lowered == "bi")
            chosen = F.when(named, variants(patterns)).otherwise(chosen)
        return F.slice(F.array_distinct(chosen), 1, MAX_VARIANTS)

    pair = let(clean_question(question), lambda c: F.struct(c.alias("cleaned"), F.lower(c).alias("lowered")))
    return let(pair, choose)


def question_terms(question: str) -> list[str]:
    """Distinct words of more than two characters of one literal question."""
    words = re.findall(r"\w+", question.lower())
    return sorted({word for word in words if len(word) > 2})


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(word) for word in words))


def _count_named(text: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + F.contains(text, F.lit(word)).cast("int")
    return total


def title_score(title: Column, question: str) -> Column:
    """Number of question terms in the title; null when the title is no candidate.

    The title is bound once as the element of a one-element array. A filter on
    the score would otherwise repeat the expression behind the title, often a
    pattern over a whole page, for every word.
    """
    wanted = question_terms(question)

    def score_of(lowered: Column) -> Column:
        score = _count_named(lowered, wanted)
        candidate = (score > 0) | _has_any(lowered, MARKET_WORDS)
        if set(wanted) & set(COMMODITIES):
            candidate = candidate & _has_any(lowered, COMMODITY_WORDS)
        return F.when(candidate, score)

    return F.get(F.transform(F.array(F.lower(title)), score_of), F.lit(0))


def article_relevance(title: Column, content: Column, question: str) -> Column:
    """Share of question terms found, counting at most four, rounded to three digits."""
    wanted = question_terms(question)
    share = F.lit(max(1, min(len(wanted), 4)))
    text = F.array(F.lower(F.concat_ws(" ", title, content)))
    found = F.get(F.transform(text, lambda lowered: _count_named(lowered, wanted)), F.lit(0))
    return F.round(F.least(F.lit(1.0), found / share), 3)
