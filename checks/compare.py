"""Compare the registered queries with their SQL: python -m checks.compare [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda v: "None" if v is None else repr(float(v)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} instead of {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    a, b = normal(got), normal(want)
    if a.equals(b):
        return None
    rows = (a != b).any(axis=1)
    first = rows.idxmax()
    return f"{int(rows.sum())} rows differ, first {a.loc[first].to_dict()} instead of {b.loc[first].to_dict()}"


def main() -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES
    from hushframe.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    con, spark, bad = connection(sf_dir), local_session("8"), 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in ORACLES:
                problem = difference(got, con.sql(ORACLES[name]).df())
            else:
                problem = None if len(got) else "no rows"
        except Exception as error:  # noqa: BLE001
            took, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:32} {'ok' if problem is None else 'BAD'} {took:6.2f}s {'' if problem else len(got)} {problem or ''}", flush=True)
    print(f"{bad} of {len(names)} differ")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
