"""Compare catalogue queries with their SQL: python tools_check.py <sf_dir> [name ...]"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

from fragweave.plans.catalog import oracle_sql, queries
from fragweave.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f" or str(df[c].dtype) in ("Float64", "Int64"):
            df[c] = df[c].astype(float).round(9) + 0.0
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f" or y.dtype.kind == "f":
            x, y = x.astype(float), y.astype(float)
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = same.idxmin()
            return f"column {c}: {(~same).sum()} differ, e.g. {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return "ok"


def types_differ(got, want_rel) -> str:
    kind = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    want = dict(zip(want_rel.columns, map(str, want_rel.types)))
    bad = {f.name: (f.dataType.simpleString(), want.get(f.name)) for f in got.schema.fields
           if kind.get(f.dataType.simpleString()) != want.get(f.name)}
    return f" types {bad}" if bad else ""


def main(sf: str, names: list[str]) -> int:
    spark = local_session("check", 8)
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    qs, sqls = queries(), oracle_sql()
    failures = 0
    for name in names or qs:
        try:
            t0 = time.time()
            df = qs[name](spark, sf)
            got = df.toPandas()
            t1 = time.time()
            if name not in sqls:
                print(f"{name:28s} rows-only {len(got):8d} {t1 - t0:6.2f}s", flush=True)
                continue
            rel = con.sql(sqls[name])
            note = types_differ(df, rel)
            want = rel.df()
            res = compare(got, want)
            failures += res != "ok"
            print(f"{name:28s} {res} {len(got):8d} rows  spark {t1 - t0:6.2f}s duckdb {time.time() - t1:6.2f}s{note}", flush=True)
        except Exception as e:  # report and go on
            failures += 1
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:700]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], [a for a in sys.argv[2:] if a != "-v"])))
