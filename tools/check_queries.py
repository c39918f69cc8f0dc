"""Run registered queries next to their check SQL in DuckDB and compare all rows.

usage: python tools/check_queries.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfprice import build_session  # noqa: E402
from shelfprice.plans import oracle_sql, queries  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def family(series: pd.Series) -> str:
    kind = series.dtype.kind
    if kind == "O":
        present = series.dropna()
        value = present.iloc[0] if len(present) else None
        return type(value).__name__
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "date"}.get(kind, kind)


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "M":
            frame[c] = frame[c].astype(str)
        elif frame[c].dtype.kind == "O":
            frame[c] = frame[c].map(lambda v: None if v is None or v is pd.NaT else (v if isinstance(v, (str, int, float, bool)) else str(v)))
    return frame.sort_values(list(frame.columns), kind="stable", na_position="first").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    notes = [f"{c}:{family(got[c])}/{family(want[c])}" for c in got.columns if family(got[c]) != family(want[c])]
    notes = [n for n in notes if not n.endswith(("date/date",)) and "NoneType" not in n]
    a, b = canonical(got), canonical(want)
    bad = []
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f" or y.dtype.kind == "f":
            x, y = x.astype(float), y.astype(float)
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = int((~same).to_numpy().nonzero()[0][0])
            bad.append(f"{c}: {int((~same).sum())} differ, first {x[i]!r} vs {y[i]!r}")
    return "; ".join(bad + (["types " + ",".join(notes)] if notes else [])) or "ok"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--folder", help="tables to use instead of those of --sf")
    parser.add_argument("--no-broadcast", action="store_true", help="plan as if no table were small enough to broadcast")
    args = parser.parse_args()
    folder = args.folder or f"/root/testdata/sf{args.sf}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    if args.no_broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    con = duck(folder)
    plans, checks = queries(), oracle_sql()
    failed = 0
    for name in args.names or plans:
        start = time.time()
        try:
            got = plans[name](spark, folder).toPandas()
            seconds = time.time() - start
            if name in checks:
                verdict = compare(got, con.execute(checks[name]).fetchdf())
            else:
                verdict = "rows only"
            failed += verdict not in ("ok", "rows only")
            print(f"{name:28s} {len(got):8d} rows {seconds:6.2f}s  {verdict}", flush=True)
        except Exception as error:
            failed += 1
            print(f"{name:28s} ERROR {str(error)[:600]}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
