"""Run registered queries against their SQL: ``python -m tests.oracle_check <sf_dir> [name…]``."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return f"{v:.9g}"
    return (type(v).__name__, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = df.collect()
    con.execute(sql)
    cols = [c[0] for c in con.description]
    want = con.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return None if a else "both sides are empty"
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return f"rows {len(a)} vs {len(b)}\n   spark only {sorted(sa - sb)[:3]}\n   sql only   {sorted(sb - sa)[:3]}"


def main(argv):
    from docaudit.queries import load
    from docaudit.session import local_session

    queries, oracles = load()
    spark, con = local_session(8), connect(argv[0])
    wanted = [n for n in queries if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    bad = 0
    for name in wanted:
        t = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, queries[name], oracles[name], argv[0])
            else:
                problem = None if queries[name](spark, argv[0]).collect() else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} good")


if __name__ == "__main__":
    main(sys.argv[1:])
