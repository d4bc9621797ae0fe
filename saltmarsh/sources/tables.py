"""Table scans: CSV, Parquet and folders that mix formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.sources.workbook import read_workbooks

# File extensions per format; everything else is read as CSV.
EXTENSIONS = {"parquet": ("parquet",), "excel": ("xlsx",)}


def read_csv(spark: SparkSession, path: str, typed: bool = True, schema: str | None = None) -> DataFrame:
    """CSV with header. A given schema saves the extra pass that type inference needs."""
    reader = spark.read.option("header", True)
    if schema:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", typed).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_csv(spark, path) if fmt == "csv" else read_parquet(spark, path)


def _extensions(spark: SparkSession, path: str) -> set[str]:
    """Extensions that occur in a folder; only the file listing is read."""
    names = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).selectExpr(
            "lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)) AS ext"
        )
    )
    return {row["ext"] for row in names.distinct().collect()}  # one row per extension


def read_folder(spark: SparkSession, path: str, fmt: str | None = None, sheet: tuple[str, ...] | None = None) -> DataFrame:
    """All tables of a folder as one, matched by column name; absent columns are null.

    Without ``fmt`` each file is read by its extension (Parquet, XLSX, else CSV);
    each extension is one scan with many files.
    """
    if fmt is not None and fmt not in ("parquet", "excel", "csv"):
        raise ValueError(f"unsupported format {fmt!r}")
    found = _extensions(spark, path)
    if not found:
        raise FileNotFoundError(f"no files below {path}")
    frames = []
    for ext in sorted(found):
        kind = fmt or next((k for k, names in EXTENSIONS.items() if ext in names), "csv")
        glob = "*" if not ext else "*." + "".join(f"[{c}{c.upper()}]" for c in ext)
        if kind == "excel":
            frames.append(read_workbooks(spark, path, glob=glob))
            continue
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        frames.append(
            reader.parquet(path) if kind == "parquet" else reader.option("header", True).option("inferSchema", True).csv(path)
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
