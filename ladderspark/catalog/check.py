"""Compare registered queries with their SQL on one dataset: python -m ladderspark.catalog.check [names]."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from ladderspark.catalog import load


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ladderspark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*cols).collect()]
    if sql is None:
        return f"rows-only {len(got)}", True, got[:2]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    at = [names.index(c) if c in names else None for c in cols]
    if None in at or len(names) != len(cols):
        return f"columns differ: {cols} vs {sorted(names)}", False, []
    types = [str(rel.description[i][1]) for i in at]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda t: tuple((x is None, str(type(x)), str(x)) for x in t)
    got.sort(key=key)
    want.sort(key=key)
    if got != want:
        wanted, gotten = set(want), set(got)
        a = [r for r in got if r not in wanted][:3]
        b = [r for r in want if r not in gotten][:3]
        return f"DIFF rows {len(got)} vs {len(want)} cols {cols}\n   spark {a}\n   sql   {b}", False, []
    spark_types = dict(df.dtypes)
    odd = [f"{c}:{spark_types[c]}/{t}" for c, t in zip(cols, types) if not same_type(spark_types[c], t)]
    return f"ok {len(got)} rows" + (f"  TYPES {odd}" if odd else "") + ("  EMPTY" if not got else ""), True, []


def same_type(a: str, b: str) -> bool:
    table = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "date": "DATE", "timestamp": "TIMESTAMP"}
    return table.get(a, a) == b or b in ("NUMBER",) 


def main():
    args = sys.argv[1:]
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    queries, sql = load()
    chosen = [q for q in queries if not args or any(q == a or (a.endswith("*") and q.startswith(a[:-1])) for a in args)]
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in chosen:
        t = time.time()
        try:
            text, ok, sample = compare(spark, con, sf_dir, queries[name], sql.get(name))
        except Exception as ex:
            text, ok, sample = f"ERROR {type(ex).__name__}: {str(ex)[:1500]}", False, []
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name}: {text} [{time.time() - t:.1f}s] {sample if sample else ''}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")


if __name__ == "__main__":
    main()
