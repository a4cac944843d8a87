"""Run registered queries against their SQL on DuckDB: ``python tools/check_oracle.py FOLDER [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairlens.catalog import ORACLES, QUERIES  # noqa: E402
from pairlens.catalog.views import TABLES  # noqa: E402


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pairlens")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, folder, name) -> str:
    start = time.time()
    df = QUERIES[name](spark, folder)
    got, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in ORACLES:
        return f"rows {len(got)} ({took:.1f}s)"
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want, expected = rows_of(names, result.fetchall())
    if columns != expected:
        return f"FAIL columns {columns} != {expected}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"FAIL rows {len(got)}/{len(want)} {diff}"
    return f"ok {len(got)} ({took:.1f}s)"


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


if __name__ == "__main__":
    target, *wanted = sys.argv[1:]
    spark, con = session(), connect(target)
    failed = 0
    for name in wanted or QUERIES:
        try:
            text = compare(spark, con, target, name)
        except Exception as error:  # noqa: BLE001
            text = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        failed += text.startswith("FAIL")
        print(f"{name}: {text}", flush=True)
    print(f"{failed} failed")
