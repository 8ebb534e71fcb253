"""Run registered queries against their SQL checks: python tests/check_oracles.py [sf_dir] [name part ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("checks").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(dtype) -> str:
    text = str(dtype)
    for k in ("int32", "int64", "float", "bool"):
        if text.startswith(k):
            return k
    return "datetime" if text.startswith("datetime") else "object"


def canon(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "∅"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v) + 0.0)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf.itertuples(index=False))


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    start = time.time()
    got = fn(spark, sf_dir).toPandas()
    took = time.time() - start
    if sql is None:
        return f"ROWS {len(got):7d} {took:6.1f}s" + ("" if len(got) else "  EMPTY")
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLS {sorted(got.columns)} vs {sorted(want.columns)}"
    kinds = {c: (kind(got[c].dtype), kind(want[c].dtype)) for c in got.columns if kind(got[c].dtype) != kind(want[c].dtype)}
    a, b = canon(got), canon(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"DIFF rows {len(a)} vs {len(b)} {diff} {kinds}"
    return f"ok   {len(a):7d} {took:6.1f}s" + (f"  types {kinds}" if kinds else "") + ("" if len(a) else "  EMPTY")


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark, con = session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            line = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on to the next query
            line = f"FAIL {type(e).__name__}: {str(e)[:600]}"
        bad += not line.startswith(("ok", "ROWS"))
        print(f"{name:38s} {line}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
