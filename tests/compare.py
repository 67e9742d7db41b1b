"""Side-by-side run of a registered query and its SQL.

``python -m tests.compare [name ...]`` checks the named queries (default all)
at $SF_DIR (default sf0.01).
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) else round(v, 9))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def keyed(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    names, rows = keyed(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want_names, want = keyed(cols, rel.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}; spark {rows[:2]} sql {want[:2]}"
    for got, expected in zip(rows, want):
        if got != expected:
            bad = sum(a != b for a, b in zip(rows, want))
            return f"{bad} rows differ, first {dict(zip(names, got))} != {dict(zip(names, expected))}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from clickloom.plans.catalog import ORACLE, QUERIES
    from clickloom.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(sf_dir)
    names = sys.argv[1:] or list(QUERIES)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                why = differences(df, con, ORACLE[name])
            else:
                why = None if df.count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += why is not None
        mark = "ok " if why is None else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s{'' if name in ORACLE else ' (rows only)'} {(why or '')[:700]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
