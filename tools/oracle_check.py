"""Run registered queries on Spark and their SQL twins on DuckDB; compare.

    python tools/oracle_check.py [sf_dir] [name ...]

Columns are compared by name; rows order-insensitively; floats exactly.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def rows_of(cols, records):
    order = sorted(cols)
    idx = [cols.index(c) for c in order]
    out = [tuple(_norm(r[i]) for i in idx) for r in records]
    return order, sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in r))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE", "smallint": "SMALLINT"}


def type_diff(sdf, rel):
    s = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    d = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}


def compare(spark, sf_dir, names=None, verbose=True):
    from eddy.plans.catalog import ORACLE, QUERIES
    con = duck(sf_dir)
    results = {}
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark-error", repr(e)[:400])
            if verbose:
                print(f"{name:28s} SPARK ERROR {e!r}"[:600], flush=True)
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            results[name] = ("rows-only", len(s_rows))
            if verbose:
                print(f"{name:28s} rows-only  rows={len(s_rows)}  spark={ts:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(ORACLE[name])
            d_cols = rel.columns
            d_rows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("sql-error", repr(e)[:400])
            if verbose:
                print(f"{name:28s} SQL ERROR {e!r}"[:600], flush=True)
            continue
        sc, sr = rows_of(s_cols, s_rows)
        dc, dr = rows_of(d_cols, d_rows)
        ok = sc == dc and sr == dr
        detail = ""
        td = type_diff(df, rel)
        if td:
            ok = False
            detail = f"types {td}"
        if not ok:
            if detail:
                pass
            elif sc != dc:
                detail = f"cols spark={sc} duck={dc}"
            elif len(sr) != len(dr):
                detail = f"rows spark={len(sr)} duck={len(dr)}"
            else:
                for a, b in zip(sr, dr):
                    if a != b:
                        detail = f"first diff spark={a} duck={b}"
                        break
        results[name] = ("match" if ok else "MISMATCH", detail)
        if verbose:
            print(f"{name:28s} {'match' if ok else 'MISMATCH'} rows={len(sr)} spark={ts:.1f}s {detail}"[:900],
                  flush=True)
    return results


if __name__ == "__main__":
    from eddy.config import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]")
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("match", "rows-only")]
    print("BAD:", bad)
