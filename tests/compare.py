"""Run registered queries on Spark and their twins on DuckDB, and compare all values.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and pd.isna(v)):
            return "\0null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def check(spark, con, query, oracle: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    spark_s = time.time() - start
    if oracle is None:
        return bool(got), f"rows {len(got)} (no twin) {spark_s:.1f}s"
    start = time.time()
    result = con.execute(oracle)
    names = [d[0] for d in result.description]
    want = canonical(result.fetchall(), names)
    note = f"rows {len(got)} spark {spark_s:.1f}s duckdb {time.time() - start:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        differ = [(g, w) for g, w in zip(got, want) if g != w]
        return False, f"{note} want {len(want)} rows; first difference {str(differ[:1])[:600]}"
    return True, note


if __name__ == "__main__":
    import __spark_entry__ as entry
    from paragauge.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), duck(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        try:
            good, note = check(spark, con, query, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            good, note = False, str(error)[:600].replace("\n", " ")
        failed += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print("failed:", failed)
