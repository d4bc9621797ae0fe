"""Upload job: one table through bronze, silver, gold and a short forecast, with a manifest."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from saltmarsh.operators.cleaning import coerce_by_content
from saltmarsh.operators.forecast import trend_forecast, trend_models
from saltmarsh.operators.rows import distinct_rows
from saltmarsh.scratch import run_folder
from saltmarsh.sources.sinks import layer_metadata, verified_write, write_manifest


@dataclass
class UploadResult:
    job_id: str
    folder: str
    forecast: DataFrame
    metrics: DataFrame


def upload_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def silver_upload(source: DataFrame) -> DataFrame:
    names = [upload_name(c) for c in source.columns]
    if len(set(names)) != len(names):
        raise ValueError("column names are not distinct after normalisation")
    return distinct_rows(coerce_by_content(source.toDF(*names)))


def gold_upload(silver: DataFrame, date: str, target: str) -> DataFrame:
    """Forecast-ready rows: date and target only, complete."""
    return silver.select(date, target).dropna()


def as_series(gold: DataFrame, date: str, target: str) -> DataFrame:
    return gold.select(F.lit("upload").alias("series_id"), F.col(date).cast("date").alias("ds"), F.col(target).cast("double").alias("y"))


def run_upload(source: DataFrame, file_name: str, date: str, target: str, horizon: int = 14, base: str | None = None) -> UploadResult:
    """Run all layers; each layer is written once and the next one reads it back."""
    spark = source.sparkSession
    job = uuid.uuid4().hex
    folder = f"{base or run_folder(spark, 'uploads')}/jobs/{job}"
    layers = {
        "bronze": lambda: source.toDF(*[upload_name(c) for c in source.columns]),
        "silver": lambda: silver_upload(spark.read.parquet(f"{folder}/bronze/data")),
        "gold": lambda: gold_upload(spark.read.parquet(f"{folder}/silver/data"), upload_name(date), upload_name(target)),
    }
    stages = {}
    before = file_name
    for name, build in layers.items():
        path = f"{folder}/{name}/data"
        check = verified_write(build(), path).first()
        if not check["verified"]:
            raise OSError(f"verification of {path} failed: {check}")
        layer_metadata(spark.read.parquet(path), name, job, before, path, copies=name == "silver").write.json(f"{folder}/{name}/metadata")
        stages[name] = {"object": path, "rows": check["rows_stored"], "status": "completed"}
        before = path
    series = as_series(spark.read.parquet(f"{folder}/gold/data"), upload_name(date), upload_name(target))
    rows = trend_forecast(series, horizon).drop("series_id")
    path = f"{folder}/forecast/data"
    check = verified_write(rows, path).first()
    stages["forecast"] = {"object": path, "rows": check["rows_stored"], "status": "completed"}
    created = dt.datetime.now(dt.timezone.utc).isoformat()
    write_manifest(spark, f"{folder}/manifest", job, file_name, created, stages)
    return UploadResult(job, folder, spark.read.parquet(path), trend_models(series).drop("series_id"))
