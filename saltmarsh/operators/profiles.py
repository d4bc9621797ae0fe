"""Profiles that merge: counts, moments and sketches of a load, stored, and put together for all loads.

The profile of a table that grows load by load never reads an old load again. Counts, means and
deviations of merged profiles are those of the whole. Distinct values, distinct
rows and quantiles come from sketches with known errors (``DISTINCT_ERROR`` and
``RANK_ERROR``, met by nearly all estimates); whoever decides by them near a limit counts exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from saltmarsh.operators.rows import row_digest

# Size of the sketches, as powers of two or as the library names it.
HLL_BITS = 14
THETA_BITS = 14
KLL_SIZE = 400
# Three and a half deviations of the sketches of these sizes.
DISTINCT_ERROR = 0.03
RANK_ERROR = 0.02
WHOLE = "*"


def _number(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.trim(column).try_cast("double")
    return column.try_cast("double") if isinstance(field.dataType, T.NumericType) else F.lit(None).cast("double")


def load_profile(df: DataFrame) -> DataFrame:
    """One row per column, and one for whole rows named ``*``, from one aggregate over the load."""
    entries = []
    for field in df.schema:
        column, number = F.col(f"`{field.name}`"), _number(field)
        entries.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.count(F.lit(1)).alias("rows"),
                F.count(column).alias("filled"),
                F.count(number).alias("numbers"),
                F.avg(number).alias("mean"),
                (F.var_pop(number) * F.count(number)).alias("squares"),
                F.min(number).alias("least"),
                F.max(number).alias("most"),
                F.hll_sketch_agg(F.when(column.isNotNull(), F.xxhash64(column)), HLL_BITS).alias("distinct"),
                F.kll_sketch_agg_double(number, KLL_SIZE).alias("quantiles"),
                F.lit(None).cast("binary").alias("copies"),
            )
        )
    nothing = {"filled": "bigint", "numbers": "bigint", "mean": "double", "squares": "double", "least": "double", "most": "double", "distinct": "binary", "quantiles": "binary"}
    whole = F.struct(
        F.lit(WHOLE).alias("column_name"), F.count(F.lit(1)).alias("rows"), *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()],
        F.theta_sketch_agg(row_digest(df.columns), THETA_BITS).alias("copies"),
    )
    return df.agg(F.array(*entries, whole).alias("e")).select(F.inline("e"))


def store_profile(profile: DataFrame, path: str, load: str) -> None:
    """Keep the profile of a load; the same load again replaces its own."""
    profile.coalesce(1).write.mode("overwrite").parquet(f"{path}/load={load}")


def stored_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(profiles: DataFrame) -> DataFrame:
    """One row per column over all loads, with the same sketches, so that merged profiles merge again."""
    weighted = F.col("mean") * F.col("numbers")
    sums = profiles.groupBy("column_name").agg(
        *[F.sum(c).alias(c) for c in ("rows", "filled", "numbers")],
        F.sum(weighted).alias("_sum"),
        (F.sum("squares") + F.sum(weighted * F.col("mean"))).alias("_squares"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.collect_list("quantiles").alias("_quantiles"),
        F.theta_union_agg("copies").alias("copies"),
    )
    first = F.get("_quantiles", F.lit(0))
    rest = F.when(F.size("_quantiles") > 1, F.slice("_quantiles", F.lit(2), F.size("_quantiles"))).otherwise(F.array().cast("array<binary>"))
    quantiles = F.when(first.isNotNull(), F.aggregate(rest, first, lambda a, b: F.kll_sketch_merge_double(a, b)))
    mean = F.try_divide(F.col("_sum"), F.col("numbers"))
    return sums.select(
        "column_name", "rows", "filled", "numbers", mean.alias("mean"), F.greatest(F.col("_squares") - F.col("_sum") * mean, F.lit(0.0)).alias("squares"),
        "least", "most", "distinct", quantiles.alias("quantiles"), "copies",
    )


def described(profile: DataFrame, quantile: float = 0.5) -> DataFrame:
    """column_name, rows, nulls, mean, deviation, range, estimated distinct values (of ``*``: distinct rows) and a quantile of each column."""
    of_numbers = F.col("numbers") > 0
    return profile.select(
        "column_name", "rows", (F.col("rows") - F.col("filled")).alias("nulls"), "mean",
        F.sqrt(F.try_divide(F.col("squares"), F.col("numbers") - 1)).alias("stddev"), "least", "most",
        F.when(F.col("column_name") == WHOLE, F.theta_sketch_estimate("copies")).otherwise(F.hll_sketch_estimate("distinct")).alias("distinct_count"),
        F.when(of_numbers, F.kll_sketch_get_quantile_double("quantiles", F.lit(quantile))).alias("quantile"),
    )
