"""Run registered queries in Spark and their oracle SQL in DuckDB and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

STRICT = os.environ.get("ORACLE_STRICT") == "1"

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else round(v, 9)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    same = ok_cols and a == b
    msg = f"{'OK ' if same else 'BAD'} {name}: spark {len(srows)} rows {t1 - t0:.1f}s, duck {len(drows)} rows"
    if not ok_cols:
        msg += f"\n   cols spark={sorted(scols)}\n   cols duck ={sorted(dcols)}"
    elif not same:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        msg += f"\n   first diffs: {diff}"
        msg += f"\n   spark types: {sdf.dtypes}\n   duck  types: {[(d[0], d[1]) for d in res.description]}"
    print(msg, flush=True)
    return same


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from staywise.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", shuffle_partitions=8)
    if os.environ.get("ORACLE_TZ"):  # results must not depend on the session time zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["ORACLE_TZ"])
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = []
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in orc:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"ROWS {name}: {n} rows {time.time() - t0:.1f}s (no oracle)", flush=True)
            continue
        try:
            if not compare(spark, con, name, fn, orc[name], sf_dir):
                bad.append(name)
        except Exception as e:  # report and continue
            print(f"ERR {name}: {type(e).__name__}: {str(e)[:800]}", flush=True)
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
