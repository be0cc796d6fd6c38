"""Run registered queries against their DuckDB twins (local stand-in for
the driver's correctness gate).

    python tests/oracle_check.py [sf_dir] [name ...]

Prints one line per query: rows, column match, value-hash match.
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if v != v:
            return "nan"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, con, name, fn, sql, sf_dir, show=3):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t0
    if sql is None:
        print(f"{name:40s} rows={len(srows):7d} spark={ts:6.2f}s  (no oracle)")
        return True
    t0 = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    td = time.time() - t0
    sh, sl = digest(srows, scols)
    dh, dl = digest(drows, dcols)
    ok_cols = sorted(scols) == sorted(dcols)
    ok = ok_cols and len(srows) == len(drows) and sh == dh
    print(f"{name:40s} rows={len(srows):7d}/{len(drows):7d} cols={'ok' if ok_cols else 'DIFF'} "
          f"hash={'ok' if sh == dh else 'DIFF'} spark={ts:6.2f}s duck={td:5.2f}s")
    if not ok_cols:
        print("   spark:", sorted(scols))
        print("   duck :", sorted(dcols))
    elif sh != dh:
        a, b = set(sl), set(dl)
        print("   cols :", "|".join(sorted(scols)))
        for x in sorted(a - b)[:show]:
            print("   spark-only:", x[:300])
        for x in sorted(b - a)[:show]:
            print("   duck-only :", x[:300])
    return ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as ent
    from demandlake.session import get_session
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = ent.queries(), ent.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            if not check(spark, con, name, fn, sqls.get(name), sf_dir):
                bad.append(name)
        except Exception as e:  # report and go on
            print(f"{name:40s} ERROR {type(e).__name__}: {str(e)[:400]}")
            bad.append(name)
    print("FAILED:", bad if bad else "none")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
