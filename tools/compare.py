"""Run registered queries in Spark and their oracle SQL in DuckDB and compare
row count, column names and an order-insensitive value hash.

usage: python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

sys.path.insert(0, ".")

from tally.plans.catalog import REGISTRY  # noqa: E402
from tally.session import local_session  # noqa: E402
from tally.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(REGISTRY)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        q = REGISTRY[name]
        t0 = time.time()
        df = q.build(spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        cols = df.columns
        ts = time.time() - t0
        if q.sql is None:
            print(f"{name:34s} rows={len(rows):7d} spark={ts:6.2f}s  (no oracle)")
            continue
        t0 = time.time()
        res = con.execute(q.sql)
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        to = time.time() - t0
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
        bad += not ok
        print(f"{name:34s} rows={len(rows):7d}/{len(orows):7d} cols={'ok' if sorted(cols)==sorted(ocols) else (cols, ocols)} "
              f"hash={'MATCH' if h1 == h2 else 'DIFF'} spark={ts:6.2f}s duck={to:6.2f}s")
        if not ok and h1 != h2:
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:4]:
                print("   spark only:", x)
            for x in sorted(s2 - s1)[:4]:
                print("   duck  only:", x)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
