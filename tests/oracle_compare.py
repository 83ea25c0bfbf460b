"""Run every registered query on Spark and its SQL twin on DuckDB and compare
row count, column names and an order-insensitive value hash.

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if v == int(v):
            return str(int(v))
        return f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return canon(float(v))
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def digest(cols: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and not argv[1].isidentifier() else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if a.isidentifier()]
    from tally.session import build_session
    import __spark_entry__ as E
    spark = build_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows-only {name}: {len(rows)} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        a, b = digest(cols, rows), digest(dcols, drows)
        same_cols = sorted(cols) == sorted(dcols)
        ok = same_cols and a == b
        print(f"{'OK  ' if ok else 'FAIL'} {name}: spark {a[0]} rows, duck {b[0]} rows"
              f"{'' if same_cols else f' cols {sorted(cols)} vs {sorted(dcols)}'} ({ts:.1f}s)")
        if not ok:
            bad += 1
            if same_cols:
                order = sorted(range(len(cols)), key=lambda i: cols[i])
                dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
                sa = set("|".join(canon(r[i]) for i in order) for r in rows)
                sb = set("|".join(canon(r[i]) for i in dorder) for r in drows)
                print("   spark-only:", sorted(sa - sb)[:3])
                print("   duck-only: ", sorted(sb - sa)[:3])
    print(f"{bad} failing")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
