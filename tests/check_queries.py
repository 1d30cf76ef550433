"""Compare registered queries with their SQL twins: python tests/check_queries.py [sf] [name...]"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in records),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, sf_dir, run, sql):
    """None when equal, else a short description of the first difference."""
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    cols = sorted(names)
    for a, b in zip(rows_of(got, df.columns), rows_of(want, names)):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
            return f"values {bad[:5]} in {a[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from lendframe import queries
    from lendframe.session import local_session
    queries.load_all()
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), duck(sf_dir)
    failed = []
    for name, run in queries.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in queries.ORACLES:
                note = compare(spark, con, sf_dir, run, queries.ORACLES[name])
            else:
                n = run(spark, sf_dir).count()
                note = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            note = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if note is None else 'FAIL'} {time.time() - start:6.2f}s {name}"
              f"{'' if name in queries.ORACLES else ' (rows only)'} {note or ''}", flush=True)
        if note:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
