"""Compare registered queries with their SQL in DuckDB, column by column."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, con, folder, fn, sql):
    """None when equal, else a description of the difference."""
    df = fn(spark, folder)
    names, got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    rel = con.execute(sql)
    want_names, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; {got[:2]} vs {want[:2]}"
    for a, b in zip(got, want):
        if a != b and not _close(a, b):
            return f"{names}: {a} != {b}"
    return None


def _close(a, b):
    return all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 2e-6) for x, y in zip(a, b))


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from casemill.queries import ALL
    from casemill.sources.session import local_session
    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = local_session("8"), connect(folder)
    for name, (fn, sql) in ALL.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, fn, sql)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"\n{"ok " if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
