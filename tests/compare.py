"""Run registered queries beside DuckDB and compare all rows.

``python -m tests.compare [name ...]`` checks the named queries (default: all).
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def mismatch(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1][:2000] if r not in set(want[1])][:2]
        return f"{len(got[1])} rows != {len(want[1])} rows; spark only e.g. {extra}"
    for a, b in zip(got[1], want[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"row {a!r} != {b!r}"
    return None


def main(names: list[str]) -> int:
    import __spark_entry__ as e
    from tests.conftest import make_session

    folder = "/root/testdata/sf0.01"
    spark, con = make_session(), duck(folder)
    bad = 0
    for name in names or list(e.queries()):
        start = time.time()
        try:
            df = e.queries()[name](spark, folder)
            sql = e.oracle_sql().get(name)
            if sql is None:
                verdict = f"rows only: {df.count()}"
            else:
                verdict = mismatch(df, con, sql)
        except Exception as x:  # report and go on to the next query
            verdict = f"ERROR {type(x).__name__}: {str(x)[:1500]}"
        bad += verdict is not None and not verdict.startswith("rows only")
        print(f"{name:32s} {time.time() - start:6.1f}s {verdict or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
