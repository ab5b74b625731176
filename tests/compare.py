"""Runs queries beside their SQL, much as the driver does: python tests/compare.py FOLDER [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}") + 0.0
    if type(x).__name__ == "Decimal":
        return float(f"{float(x):.6g}")
    if isinstance(x, (list, tuple)):
        return tuple(norm(v) for v in x)
    if hasattr(x, "isoformat"):
        return x.isoformat().replace("+00:00", "")
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    return float(x) if isinstance(x, int) and False else x


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}", len(got)
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} against {len(want)} rows; only here {list(a - b)[:2]}; only SQL {list(b - a)[:2]}", len(got)
    return "", len(got)


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e
    from quillon.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con, sql, bad = duck(folder), e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sql:
                why, n = compare(spark, con, folder, fn, sql[name])
            else:
                why, n = "", fn(spark, folder).count()
        except Exception as x:
            why, n = f"{type(x).__name__}: {str(x)[:600]}", -1
        bad += bool(why)
        print(f"{'BAD' if why else 'ok '} {name} {n} rows {time.time() - t:.1f}s {'sql' if name in sql else 'no sql'} {why}", flush=True)
    print("bad:", bad)
