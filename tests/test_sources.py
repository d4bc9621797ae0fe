import os
import datetime as dt
import json
import subprocess
import sys
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from saltmarsh.catalog.sources import _workbook
from saltmarsh.plans.medallion import full_run
from saltmarsh.plans.upload import run_upload
from saltmarsh.scratch import shared_base
from saltmarsh.sources import documents as docs, sinks, tables as tb
from saltmarsh.sources.workbook import read_workbooks
from saltmarsh.streaming.ingest import ingest_files, read_silver


def test_workbooks(spark, tmp_path):
    for n in range(3):
        rows = pd.DataFrame({"Name": [f"a<{n}>", "b&"], "Units Sold": [n, 5]})
        (tmp_path / f"book{n}.xlsx").write_bytes(_workbook(rows if n else rows.rename(columns={"Name": "Other"})))
    got = read_workbooks(spark, str(tmp_path)).collect()
    assert sorted((r["Name"], r["Other"], r["Units Sold"]) for r in got if r["Name"]) == [("a<1>", None, "1"), ("a<2>", None, "2"), ("b&", None, "5"), ("b&", None, "5")]
    assert sorted(r["Other"] for r in got if r["Other"]) == ["a<0>", "b&"]


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,p\n")
    (tmp_path / "b.XLSX").write_bytes(_workbook(pd.DataFrame({"x": [2], "z": ["q"]})))
    spark.createDataFrame([(3, "r")], "x int, z string").coalesce(1).write.parquet(str(tmp_path / "part"))
    got = tb.read_folder(spark, str(tmp_path))
    assert sorted((int(r["x"]), r["y"], r["z"]) for r in got.collect()) == [(1, "p", None), (2, None, "q"), (3, None, "r")]
    with pytest.raises(ValueError):
        tb.read_folder(spark, str(tmp_path), "orc")
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        tb.read_folder(spark, str(tmp_path / "empty"))


def test_articles_from_files(spark, tmp_path):
    store = tmp_path / "news" / "src"
    store.mkdir(parents=True)
    (store / "d-1.json").write_text(json.dumps({"source_type": "external_news", "title": "T", "content": " body ", "source": "S"}, indent=2))
    (store / "d-2.json").write_text("{broken")
    (store / "d-3.json").write_text(json.dumps({"source_type": "other", "content": "x"}))
    (store / "d-4.json").write_text(json.dumps({"source_type": "external_news", "topic": None, "content": "  "}))
    (store / "readme.txt").write_text("{}")
    objects = docs.read_objects(spark, str(tmp_path))
    rows = {r["object_key"]: r for r in docs.stored_articles(objects).collect()}
    assert set(rows) == {"src/d-1.json", "src/d-4.json"}
    assert (rows["src/d-1.json"]["topic"], rows["src/d-1.json"]["artifact_id"]) == ("General News", "d-1")
    assert rows["src/d-4.json"]["topic"] is None
    assert {r["content"] for r in docs.articles_to_index(objects).collect()} == {"body", "x"}


def test_text_objects_from_files(spark, tmp_path):
    base = tmp_path / "documents"
    base.mkdir()
    (base / "a.txt").write_bytes(b"ok \xff end")
    (base / "b.JSON").write_text('{"b":1,"a":"é"}')
    (base / "c.json").write_text("no json")
    (base / "d.png").write_bytes(b"x")
    got = {r["filename"]: r for r in docs.text_objects(docs.read_binaries(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.txt", "b.JSON", "c.json"}
    assert got["a.txt"]["text"] == "ok � end"
    assert got["b.JSON"]["text"] == '{\n  "b": 1,\n  "a": "é"\n}'
    assert got["c.json"]["text"] == "no json"


def test_customs_document(spark, tmp_path):
    items = [{"page": 1, "item_number": n, "type": None, "hs_code": "1", "description": "d", "transaction_value": v} for n, v in enumerate([10.5, 4.5], 1)]
    (tmp_path / "doc.json").write_text(json.dumps({"document": {"document_type": "X"}, "items": items, "values": {"total_transaction_value": 15.0}, "pages": [{"page": 1, "sections": ["a"]}]}))
    parsed = docs.customs_documents(docs.read_objects(spark, str(tmp_path)))
    total = docs.item_totals(parsed).first()
    assert (total["item_count"], total["items_total"], total["matches"]) == (2, 15.0, True)
    assert docs.document_items(parsed).count() == 2


def test_job_catalogue_from_files(spark, tmp_path):
    for key in ("jobs/j1/bronze/raw.csv", "jobs/j1/manifest.json", "jobs/j2/gold/x.csv", "other/y.csv"):
        path = tmp_path / "forecast" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    keys = docs.list_keys(spark, str(tmp_path), "forecast")
    manifests = spark.createDataFrame([("j1", '{"source_file": "s.csv", "created_at": "t", "stages": {"gold": {}}}')], "job_id string, manifest string")
    got = {r["job_id"]: (r["source_file"], r["stages"]) for r in docs.job_catalogue(keys, manifests).collect()}
    assert got == {"j1": ("s.csv", ["gold"]), "j2": (None, ["bronze", "silver", "gold", "forecast"])}


RAW = "TransactionID,Date,MobileModel,Price,UnitsSold,TotalRevenue,Location\n"


def test_full_run(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.csv").write_text(RAW + "1,2024-01-01,M1,10,2s,20,X\n2,2024-01-02,M2,5,1,5,Y\n,2024-01-02,M2,5,1,5,Y\n")
    (raw / "b.csv").write_text(RAW + "1,2024-01-01,M1,10,2,20,X\n3,2024-02-01 00:00:00,M1,\"1,000\",1,1000,X\n")
    paths = full_run(spark, str(raw), str(tmp_path / "out"))
    read = lambda name: [tuple(r) for r in spark.read.parquet(paths[name]).collect()]
    assert set(paths) == {"base", "summary", "sales_by_product", "sales_by_location", "daily_sales", "monthly_sales"}
    assert sorted(read("sales_by_product")) == [("M1", 1020.0, 3), ("M2", 5.0, 1)]
    assert sorted(read("monthly_sales")) == [(2024, "2024-01", 25.0, 3), (2024, "2024-02", 1000.0, 1)]
    assert read("summary") == [(1025.0, pytest.approx(1025 / 3), 4)]


def test_incremental_ingestion(spark, tmp_path):
    raw, base = tmp_path / "raw", str(tmp_path / "lake")
    raw.mkdir()
    columns = RAW.strip().split(",")
    (raw / "a.csv").write_text(RAW + "1,2024-01-01,M1,10,2,20,X\n")
    ingest_files(spark, str(raw), columns, base)
    (raw / "b.csv").write_text(RAW + "1,2024-01-01,M1,10,2,20,X\n2,2024-01-03,M1,10,2,20,X\n")
    ingest_files(spark, str(raw), columns, base)
    ingest_files(spark, str(raw), columns, base)
    assert sorted((r["transactionid"], r["date"]) for r in read_silver(spark, base).collect()) == [("1", dt.date(2024, 1, 1)), ("2", dt.date(2024, 1, 3))]
    assert spark.read.parquet(f"{base}/bronze").count() == 3


def test_upload_job(spark, tmp_path):
    rows = [(f"2026-01-{d:02d}", str(100 + d), "east") for d in range(1, 31)] + [("bad", "5", "east"), ("2026-01-30", "130", "east")]
    result = run_upload(spark.createDataFrame(rows, "Date string, Sales string, Region string"), "up.csv", "Date", "Sales", 7, str(tmp_path))
    got = result.forecast.orderBy("date").collect()
    assert len(got) == 14 and got[-1]["date"] == dt.date(2026, 2, 6) and got[-1]["forecast"] == pytest.approx(137.0)
    assert result.metrics.first()["mae"] == pytest.approx(0.0, abs=1e-9)
    manifest = json.loads(spark.read.text(f"{result.folder}/manifest").first()[0])
    assert manifest["source_file"] == "up.csv" and list(manifest["stages"]) == ["bronze", "silver", "gold", "forecast"]
    assert manifest["stages"]["bronze"]["rows"] == 32 and manifest["stages"]["silver"]["rows"] == 31 and manifest["stages"]["gold"]["rows"] == 30
    silver = spark.read.json(f"{result.folder}/silver/metadata").first()
    assert silver["missing_values"] == 1 and silver["status"] == "completed"


def test_verified_write_and_formats(spark, tmp_path):
    check = sinks.verified_write(spark.range(100).select("id", (F.col("id") / 3).alias("x")), str(tmp_path / "t")).first()
    assert tuple(check) == (100, 100, True)
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), str(tmp_path / "u"), "orc")


def test_scratch_follows_the_setting(spark):
    cluster = SimpleNamespace(master="spark://host:7077", getConf=dict)
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/place/"}, sparkContext=cluster)
    assert shared_base(named) == "/shared/place"
    with pytest.raises(ValueError):
        shared_base(SimpleNamespace(conf={}, sparkContext=cluster))


def test_task_functions_carry_their_code(tmp_path):
    """What runs inside tasks loads where the package is not installed."""
    from pyspark import cloudpickle

    from saltmarsh.sources.workbook import workbook_rows
    from saltmarsh.streaming.activity import ActivityProcessor

    (tmp_path / "f").write_bytes(cloudpickle.dumps([ActivityProcessor, workbook_rows]))
    code = "import pickle; print(len(pickle.load(open('f', 'rb'))))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={}, capture_output=True, text=True, timeout=60)
    assert out.stdout.strip() == "2", out.stderr


def test_run_folders_can_be_deleted(spark):
    from saltmarsh.scratch import delete_run_folders, run_folder

    delete_run_folders(spark)
    path = run_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    run_folder(spark, "never-written")
    assert delete_run_folders(spark) == 1 and not os.path.exists(path)


def test_objects_are_written_by_several_tasks(spark, tmp_path):
    """One file per row, rows that come twice included; the tasks share the work."""
    from saltmarsh.catalog import sources

    rows = spark.range(400).select(F.lit("supplier=1").alias("folder"), F.format_string('{"n":"é%d"}', F.col("id") % 390).alias("value"))
    sources.save_objects(rows.coalesce(1), f"{tmp_path}/store/news")
    files = list((tmp_path / "store/news/supplier=1").iterdir())
    assert sorted(f.read_text() for f in files) == sorted(f'{{"n":"é{i % 390}"}}\n' for i in range(400))
    assert len({f.name.split("-")[1] for f in files}) > 1
    assert docs.read_objects(spark, str(tmp_path)).count() == 400


def test_every_supplier_is_a_listed_job(spark):
    from saltmarsh.catalog import sources

    folder = "/root/testdata/sf0.001"
    found = sources.BOOK.queries["s10_listed_jobs"](spark, folder)
    suppliers = spark.read.parquet(f"{folder}/supplier.parquet").select("s_suppkey")
    assert sorted(r.job_id for r in found.collect()) == sorted(f"supplier={r[0]}" for r in suppliers.collect())
