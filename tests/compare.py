"""Compare registered queries with their SQL on the same tables.

python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import threading
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return db


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        only_a, only_b = sorted(set(a) - set(b), key=str)[:2], sorted(set(b) - set(a), key=str)[:2]
        return f"rows {len(a)} != {len(b)}; only spark {only_a}; only sql {only_b}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]} on {sorted(got.columns)}"
    return None


def main() -> int:
    from gridwarden.session import build_session
    from gridwarden.workload import ORACLES, QUERIES

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    folder = f"/root/testdata/sf{opts.sf}"
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    db = database(folder)
    failed = []
    names = [n for n in QUERIES if not opts.names or any(n == o or (o.endswith("*") and n.startswith(o[:-1])) for o in opts.names)]
    for name in names:
        start = time.time()
        print(f"  .. {name}", file=sys.stderr, flush=True)
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name in ORACLES:
                guard = threading.Timer(60, db.interrupt)
                guard.start()
                want = db.execute(ORACLES[name]).df()
                guard.cancel()
                problem = difference(got, want)
                if problem is None and got.empty:
                    problem = "both empty"
            else:
                problem = None
            state = "ok" if problem is None else "DIFF " + problem
            if name not in ORACLES:
                state = "rows-only"
            print(f"{name:40s} {took:6.2f}s {len(got):7d} {state[:700]}", flush=True)
        except Exception as exc:  # noqa: BLE001
            problem = str(exc)
            print(f"{name:40s} ERROR {type(exc).__name__} {problem[:600]}", flush=True)
        if problem is not None:
            failed.append(name)
    print(f"{len(names)} queries, {len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
