"""Run registered queries in Spark and their oracle SQL in DuckDB, and compare.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
Prints one line per query: OK / MISMATCH / ERROR / NO-ORACLE.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
            "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
            "array<string>": "VARCHAR[]", "array<float>": "FLOAT[]"}


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{round(float(v), 6):.6f}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from chatlake.session import build_session
    import __spark_entry__ as E
    spark = build_session(shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            s_cols = df.columns
            s_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"ERROR     {name}: spark {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"NO-ORACLE {name}: rows={len(s_rows)} ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sqls[name])
            d_cols = [c[0] for c in cur.description]
            d_types = {c[0]: str(c[1]) for c in cur.description}
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR     {name}: duckdb {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = canon(s_cols, s_rows)
        dc, dr = canon(d_cols, d_rows)
        if sc != dc or sr != dr:
            bad += 1
            print(f"MISMATCH  {name}: spark rows={len(sr)} cols={sc}\n          duck  rows={len(dr)} cols={dc}")
            diff_s = [r for r in sr if r not in set(dr)][:3]
            diff_d = [r for r in dr if r not in set(sr)][:3]
            print(f"          only spark: {diff_s}\n          only duck:  {diff_d}")
        else:
            tmis = [(c, s_types.get(c), d_types.get(c)) for c in s_cols
                    if TYPE_MAP.get(s_types.get(c), s_types.get(c)) != d_types.get(c)]
            note = f" TYPES {tmis}" if tmis else ""
            print(f"OK        {name}: rows={len(sr)} ({ts:.1f}s){note}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
