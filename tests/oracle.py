"""Compare a query with its SQL on DuckDB over the same Parquet files."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if hasattr(value, "item") and not isinstance(value, (bytes, str)):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.10g}") if not value.is_integer() else int(value)
    if isinstance(value, int):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return float(value) if value % 1 else int(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def _unit(value: float) -> float:
    """One unit of the last digit that a number shows, of ten significant ones."""
    shown = f"{value:.10g}"
    if "e" in shown:
        return abs(value) * 1e-9
    return 10.0 ** -len(shown.partition(".")[2])


def equal_but_for_ties(mine: list[tuple], theirs: list[tuple]) -> bool:
    """True when rows differ only by one unit of the last digit, where an exact tie was rounded.

    The two engines round a decimal tie in different directions.
    """

    def number(value) -> bool:
        return isinstance(value, (int, float)) and not isinstance(value, bool)

    def keyed(rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda r: (tuple(repr(v) for v in r if isinstance(v, str)), tuple(v for v in r if number(v))))

    if len(mine) != len(theirs):
        return False
    for left, right in zip(keyed(mine), keyed(theirs)):
        for a, b in zip(left, right):
            if a != b and not (number(a) and number(b) and (isinstance(a, float) or isinstance(b, float)) and abs(a - b) <= 1.01 * min(_unit(a), _unit(b))):
                return False
    return True


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> tuple[str, int, float]:
    start = time.perf_counter()
    frame = query(spark, folder)
    names = frame.columns
    rows = [tuple(r) for r in frame.collect()]
    seconds = time.perf_counter() - start
    if sql is None:
        return "rows-only", len(rows), seconds
    cursor = con.execute(sql)
    other_names = [d[0] for d in cursor.description]
    other = cursor.fetchall()
    if sorted(names) != sorted(other_names):
        return f"columns differ: {sorted(names)} / {sorted(other_names)}", len(rows), seconds
    mine, theirs = rows_of(names, rows), rows_of(other_names, other)
    if mine == theirs:
        return "ok", len(rows), seconds
    extra, lost = mine - theirs, theirs - mine
    if equal_but_for_ties(list(extra.elements()), list(lost.elements())):
        return f"ok but for {sum(extra.values())} rounded ties", len(rows), seconds
    return (
        f"rows differ: {len(rows)} / {len(other)}; only here {sum(extra.values())}, only SQL {sum(lost.values())}\n"
        f"   here {[str(x)[:400] for x in list(extra)[:2]]}\n   sql  {[str(x)[:400] for x in list(lost)[:2]]}",
        len(rows),
        seconds,
    )


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from saltmarsh.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            verdict, count, seconds = compare(spark, con, folder, name, query, sql.get(name))
        except Exception as error:  # noqa: BLE001
            verdict, count, seconds = f"ERROR {type(error).__name__}: {str(error)[:500]}", -1, 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:34s} {count:8d} rows {seconds:7.2f}s  {verdict}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
