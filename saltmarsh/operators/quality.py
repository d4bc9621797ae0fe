"""Table profiles, quality reports and column roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from saltmarsh.operators.profiles import DISTINCT_ERROR, HLL_BITS
from saltmarsh.operators.rows import row_digest

# Name parts used to pick roles.
DATE_WORDS = ("date", "time", "timestamp", "datetime")
DATE_NAMES = ("date", "ds", "timestamp", "datetime")
IDENTIFIER_WORDS = ("id", "postcode", "zip", "zipcode", "code", "reference", "ref", "number", "no")
METRIC_WORDS = (
    "sales", "revenue", "amount", "value", "total", "price", "qty", "quantity", "units", "count", "cost", "profit",
)
TARGET_SCORES = (
    (("sales", "revenue", "amount", "value", "total", "price"), 15),
    (("qty", "quantity", "units", "count"), 12),
    (("metric", "score", "rate", "percent", "profit", "cost"), 8),
    (("year", "month", "day", "hour", "minute", "second"), -5),
)
IDENTIFIER_PENALTY = (("id", "code", "key"), -20)
VARIED_BONUS = 3


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count) rows from one pass over the table."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], list(df.columns), "column_name", "null_count")


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows, surplus copies.

    A row enters the shuffle as one digest, so long text stays where it was read.
    """
    digest = row_digest(list(columns or df.columns))
    groups = df.select(digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
    ).select("total_rows", "distinct_rows", (F.col("total_rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def datetime_candidates(df: DataFrame) -> list[str]:
    typed = [
        f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    ]
    return typed + [c for c in df.columns if c.lower() in DATE_NAMES and c not in typed]


def table_profile(df: DataFrame) -> DataFrame:
    """(column_name, metric, value) rows: types, nulls, row and copy counts, date range."""
    dates = datetime_candidates(df)
    aggregates = [F.count(F.lit(1)).cast("string").alias("*|rows")]
    aggregates += [F.count_if(F.col(c).isNull()).cast("string").alias(f"{c}|null_count") for c in df.columns]
    if dates:
        day = F.col(dates[0]).try_cast("date")
        aggregates += [
            F.min(day).cast("string").alias(f"{dates[0]}|min_date"),
            F.max(day).cast("string").alias(f"{dates[0]}|max_date"),
        ]
    one = df.agg(*aggregates)
    constants = {"*|columns": str(len(df.columns))}
    constants |= {f"{f.name}|dtype": f.dataType.simpleString() for f in df.schema}
    constants |= {f"{c}|role": "numeric" for c in _numeric(df)}
    constants |= {f"{c}|role": "datetime" for c in dates}
    one = one.withColumns({name: F.lit(v) for name, v in constants.items()})
    long = one.unpivot([], one.columns, "item", "value")
    copies = duplicate_count(df).select(
        F.lit("*|duplicate_rows").alias("item"), F.col("duplicate_rows").cast("string").alias("value")
    )
    both = long.unionByName(copies)
    return both.select(
        F.regexp_extract("item", r"^(.*)\|", 1).alias("column_name"),
        F.regexp_extract("item", r"\|([^|]*)$", 1).alias("metric"),
        "value",
    )


def quality_score(df: DataFrame, copies: bool = True) -> DataFrame:
    """Missing cells, missing share, copies and the 0..100 score of the table without copies.

    Without ``copies`` every row counts, and no row is shuffled.
    """
    width = len(df.columns)
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + F.col(c).isNull().cast("int")
    if copies:
        rows = df.select(row_digest(df.columns).alias("digest"), missing.alias("missing"))
        groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_copies"), F.max("missing").alias("missing"))
    else:
        groups = df.select(F.lit(1).cast("bigint").alias("_copies"), missing.alias("missing"))
    totals = groups.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_before"),
    )
    cells = F.greatest(F.lit(1), F.col("row_count") * width)
    share = F.col("missing_values") / cells
    return totals.select(
        "row_count",
        F.lit(width).alias("column_count"),
        "missing_values",
        F.round(share * 100, 2).alias("missing_percentage"),
        (F.col("rows_before") - F.col("row_count")).alias("duplicates_removed"),
        F.round(F.greatest(F.lit(0.0), F.lit(100.0) * (1 - share)), 2).alias("quality_score"),
    )


def _named(name: str, words: Sequence[str]) -> bool:
    return any(word in name.lower() for word in words)


def _name_tokens(name: str) -> set[str]:
    import re

    spaced = re.sub("([a-z0-9])([A-Z])", r"\1_\2", name)
    return set(re.findall("[a-z0-9]+", spaced.lower()))


def identifier_name(name: str) -> bool:
    """True when a whole word of the name says identifier (``paid`` and ``width`` do not)."""
    return bool(_name_tokens(name) & set(IDENTIFIER_WORDS))


def distinct_share(df: DataFrame, column: str) -> DataFrame:
    """Exact distinct share of one column; copies are combined before the shuffle."""
    groups = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return groups.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.count(column).alias("distinct_count"),
    ).select(
        F.lit(column).alias("column_name"),
        "row_count",
        "distinct_count",
        F.round(F.col("distinct_count") / F.greatest(F.col("row_count"), F.lit(1)), 6).alias("distinct_share"),
    )


def column_statistics(df: DataFrame) -> DataFrame:
    """One row per column: parse shares, approximate distinct share, coefficient of variation.

    Everything comes from a single aggregate; distinct counts are approximate
    because an exact count of every column would multiply the rows.
    """
    specs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for f in df.schema:
        text = isinstance(f.dataType, T.StringType)
        col = F.col(f.name)
        temporal = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        number = F.trim(col).try_cast("double") if text else col.try_cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        date = F.trim(col).try_cast("timestamp_ntz") if text else col if temporal else F.lit(None).cast("date")
        specs.append(
            F.struct(
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.avg(date.isNotNull().cast("int")).alias("date_share"),
                F.avg(number.isNotNull().cast("int")).alias("number_share"),
                F.count(col).alias("filled"),
                F.hll_sketch_estimate(F.hll_sketch_agg(F.when(col.isNotNull(), F.xxhash64(col)), HLL_BITS)).alias("distinct_count"),
                F.avg(number).alias("mean"),
                F.stddev_samp(number).alias("stddev"),
            ).alias(f.name)
        )
    one = df.agg(*specs)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("row_count"), F.col(f"`{c}`").alias("s"))
        for c in df.columns
    ]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.column_name", "e.row_count", "e.s.*")


def _mostly_distinct(df: DataFrame, column: str, estimate: float, limit: float = 0.9) -> bool:
    """Whether more than the limit of all rows are different values; the estimate decides where its error cannot matter."""
    if abs(estimate - limit) > 2 * DISTINCT_ERROR * limit:
        return estimate > limit
    exact = distinct_share(df, column).first()
    return exact["distinct_count"] > limit * exact["row_count"]


def column_roles(df: DataFrame, threshold: float = 0.8) -> list[dict]:
    """Date, numeric and target columns with scores, from one pass of statistics.

    A column whose estimated share of distinct values is near the limit is counted exactly.
    """
    stats = {r["column_name"]: r for r in column_statistics(df).collect()}  # one row per column
    names = list(df.columns)
    dates = [c for c in names if _named(c, DATE_WORDS)]
    if not dates:
        dates = [c for c in names if (stats[c]["date_share"] or 0) >= threshold][:1]
    numeric = _numeric(df) or [c for c in names if (stats[c]["number_share"] or 0) >= threshold]
    roles = [{"column_name": c, "role": "date", "score": 0} for c in dates]
    roles += [{"column_name": c, "role": "numeric", "score": 0} for c in numeric]
    ranked = []
    for c in numeric:
        s = stats[c]
        unique = s["row_count"] > 10 and not _named(c, METRIC_WORDS) and _mostly_distinct(df, c, s["distinct_count"] / s["row_count"])
        if identifier_name(c) or unique:
            roles.append({"column_name": c, "role": "identifier", "score": 0})
            continue
        score = sum(points for words, points in TARGET_SCORES if _named(c, words))
        score += IDENTIFIER_PENALTY[1] if _name_tokens(c) & set(IDENTIFIER_PENALTY[0]) else 0
        if s["mean"] and s["stddev"] is not None and s["stddev"] / abs(s["mean"]) > 0.1:
            score += VARIED_BONUS
        ranked.append((score, c))
    if ranked:
        top = max(ranked, key=lambda item: item[0])
        roles.append({"column_name": top[1], "role": "target", "score": top[0]})
    elif numeric:
        roles.append({"column_name": numeric[0], "role": "target", "score": 0})
    return roles


def choose_series_columns(df: DataFrame) -> tuple[str, str]:
    """(date, metric) columns for the daily forecast; the metric prefers sales amounts."""
    stats = {r["column_name"]: r for r in column_statistics(df).collect()}  # one row per column
    dates = {
        c: (2 if (stats[c]["date_share"] or 0) > 0.8 else 0) + (3 if c.lower() in DATE_NAMES else 0)
        for c in df.columns
    }
    date = max(dates, key=lambda c: dates[c])
    if dates[date] < 2:
        raise ValueError("no usable date column")
    numeric = [c for c in _numeric(df) if c.lower() != "year"]
    if not numeric:
        raise ValueError("no numeric column")

    def preference(c: str) -> tuple[int, int]:
        points = 10 if _named(c, ("sales", "revenue", "amount", "value")) else 0
        points += 3 if _named(c, ("quantity", "units", "count")) else 0
        return points, stats[c]["filled"]

    return date, max(numeric, key=preference)
