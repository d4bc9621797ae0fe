"""Bronze-to-silver cleaning: names, text, numbers, dates, nulls."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from saltmarsh.functions.numbers import numeric_text, parse_date
from saltmarsh.operators.rows import filter_computed

# Spellings of the unit-count column, in order of preference.
ALIASES: dict[str, tuple[str, ...]] = {
    "unitssold": (
        "unitssold", "unitsold", "units_sold", "unit_sold",
        "qty", "quantity", "quantitysold", "quantity_sold",
    ),
    "customergender": ("customergender", "customer_gender"),
}

# Types of the sales columns.
NUMBER_TYPES: dict[str, str] = {
    "price": "double",
    "totalrevenue": "double",
    "unitssold": "int",
    "customerage": "int",
}

# Columns that a silver row must have.
REQUIRED = ("transactionid", "date", "price", "totalrevenue")

# Trimmed texts that stand for null.
NULL_TEXTS = ("", "NULL", "null")


def normal_name(name: str) -> str:
    return "_".join(re.findall("[0-9a-z]+", name.strip().lower()))


def normalise_names(df: DataFrame) -> DataFrame:
    names = [normal_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes or "" in names:
        raise ValueError(f"column names are not distinct after normalisation: {clashes or ['']}")
    return df.toDF(*names)


def fold_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    for canonical, spellings in aliases.items():
        if canonical in df.columns:
            continue
        present = [s for s in spellings if s in df.columns]
        if present:
            df = df.withColumnRenamed(present[0], canonical)
    return df


def clean_text_columns(df: DataFrame) -> DataFrame:
    """Trim; empty and NULL to null; runs of tabs and line ends to one blank."""

    def cleaned(name: str) -> Column:
        # Trimming is cheap and may be repeated; the pattern runs only over text that has something to replace.
        text = F.trim(F.col(name))
        uneven = text.contains("\t") | text.contains("\n") | text.contains("\r")
        even = F.when(uneven, F.regexp_replace(text, r"[\t\n\r]+", " ")).otherwise(text)
        return F.when(~text.isin(*NULL_TEXTS), even).alias(name)

    return df.select(
        *[cleaned(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    )


def sanitise_numbers(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Late typing of text columns by (case-insensitive) name."""
    wanted = {name.lower(): kind for name, kind in types.items()}
    return df.select(
        *[
            numeric_text(F.col(c)).try_cast(wanted[c.lower()]).alias(c) if c.lower() in wanted else F.col(c)
            for c in df.columns
        ]
    )


def cast_numbers(df: DataFrame, types: Mapping[str, str] = NUMBER_TYPES) -> DataFrame:
    return df.select(
        *[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
    )


def normalise_date(df: DataFrame, name: str = "date") -> DataFrame:
    if name not in df.columns:
        return df
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return df
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(name, F.to_date(name))
    return df.withColumn(name, parse_date(F.col(name)))


def fill_missing(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    present = {c: v for c, v in values.items() if c in df.columns}
    return df.na.fill(present) if present else df


def with_lineage(df: DataFrame, source_file: Column | None = None) -> DataFrame:
    """Add file name and ingestion time. Without ``source_file`` the scan's own file name is used."""
    origin = F.col("_metadata.file_name") if source_file is None else source_file
    return df.select("*", origin.alias("source_file"), F.current_timestamp().alias("ingestion_timestamp"))


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"year": F.year(date), "month": F.date_format(date, "yyyy-MM")})


def _missing(df: DataFrame, columns: Sequence[str]) -> Column:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are absent: {absent}")
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    return any_null


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED, computed: bool = False) -> DataFrame:
    """Rows with a value in every required column; an absent column is an error.

    ``computed`` says that the columns come out of cleaning steps and not of a scan.
    """
    missing = _missing(df, columns)
    return filter_computed(df, ~missing) if computed else df.dropna(subset=list(columns))


def invalid_rows(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    return df.filter(_missing(df, columns))


def validity_counts(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    """Valid, invalid and total row counts in one pass."""
    bad = _missing(df, columns)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~bad).alias("valid_rows"),
        F.count_if(bad).alias("invalid_rows"),
    )


def coerce_by_content(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Date-named columns become timestamps; text that mostly parses becomes numbers.

    One pass measures how much of every text column parses; the cleaned table is
    then a single projection.
    """

    def dated(name: str) -> bool:
        return "date" in name.lower() or "time" in name.lower()

    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and not dated(f.name)]
    numeric: set[str] = set()
    if texts:
        shares = df.agg(
            *[F.avg(F.trim(F.col(c)).try_cast("double").isNotNull().cast("int")).alias(c) for c in texts]
        ).first()
        numeric = {c for c in texts if (shares[c] or 0.0) >= threshold}

    def coerced(field: T.StructField) -> Column:
        col = F.col(field.name)
        if dated(field.name) and isinstance(field.dataType, T.StringType):
            return col.try_cast("timestamp_ntz").alias(field.name)
        if dated(field.name) and isinstance(field.dataType, T.DateType):
            return col.cast("timestamp_ntz").alias(field.name)
        if field.name in numeric:
            return F.trim(col).try_cast("double").alias(field.name)
        return col

    return df.select(*[coerced(f) for f in df.schema])
