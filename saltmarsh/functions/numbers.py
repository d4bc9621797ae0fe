"""Numbers and dates that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from saltmarsh.functions.text import strip

# Fixed value: whole text unless it is empty or spells a missing or endless number.
PRESENT_NUMBER = r"(?s)\A(?!(?:(?i:NULL|N/A|NA|NONE|UNKNOWN)|NAN|INF|-INF)?\z).*"


# Fixed value: a day, alone or followed by a time of day.
DAY = r"\A\d{4}-\d{2}-\d{2}(?= (?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d\z|\z)"


def numeric_text(text: Column) -> Column:
    """Numeric text without noise: ``60s`` -> ``60``, ``1,200.50`` -> ``1200.50``, ``N/A`` -> null.

    Each step uses the one before once, so nothing is computed twice.
    """
    bare = F.regexp_replace(strip(text.cast("string")), "[, ]", "")
    number = F.regexp_replace(bare, r"([0-9]+(?:\.[0-9]+)?)[a-zA-Z]+$", "$1")
    return F.get(F.regexp_extract_all(number, F.lit(PRESENT_NUMBER), F.lit(0)), F.lit(0))


def parse_date(text: Column) -> Column:
    """Date spelled ``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm:ss``, null otherwise.

    The pattern takes the day out of either spelling, which leaves the cast one spelling and no format to read by.
    """
    return F.regexp_extract(text, DAY, 0).try_cast("date")


def coerce_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(strip(text.cast("string")).try_cast("int"), F.lit(default))


def coerce_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(strip(text.cast("string")).try_cast("double"), F.lit(default))
