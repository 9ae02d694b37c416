"""Compare the queries of this package with their SQL: python -m tests.llm.compare [sf_dir] [query ...]."""

from __future__ import annotations

import sys
import time

from checks.compare import connection, difference
from hushframe.llm.queries import ORACLES, QUERIES
from hushframe.session import local_session


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    con, spark, bad = connection(sf_dir), local_session("8"), 0
    for name in args or list(ORACLES):
        start = time.time()
        got = QUERIES[name](spark, sf_dir).toPandas()
        took = time.time() - start
        try:
            problem = difference(got, con.sql(ORACLES[name]).df()) if name in ORACLES else None
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:24} {'ok' if problem is None else 'BAD'} {took:.1f}s {time.time() - start - took:.1f}s {len(got)} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
