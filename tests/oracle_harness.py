"""Run a registered Spark query and its DuckDB twin on the same Parquet tables and
compare row count, column names and an order-insensitive value multiset.

Usable from pytest and as a script: ``python tests/oracle_harness.py [names...]``.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else "NaN"
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


_TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "decimal": "DECIMAL",
             "float": "FLOAT", "smallint": "SMALLINT"}


def _base(t):
    return (t or "").split("(")[0]


def _base_duck(t):
    t = (t or "").upper()
    if t.startswith("DECIMAL"):
        return "DECIMAL"
    return {"NUMBER": "DOUBLE", "STRING": "VARCHAR"}.get(t, t)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    df = q(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    out = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["oracle"] = "none"
        return out
    con = con or duck_connect(sf_dir)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out.update(duck_rows=len(d_rows), duck_sec=round(time.time() - t1, 2))
    out["cols_match"] = sorted(s_cols) == sorted(d_cols)
    d_types = {d[0]: str(d[1]) for d in res.description}
    s_types = dict(df.dtypes)
    bad = {c: (s_types.get(c), d_types.get(c)) for c in s_cols
           if _TYPE_MAP.get(_base(s_types.get(c))) != _base_duck(d_types.get(c))}
    out["types_match"] = not bad
    if bad:
        out["type_diff"] = bad
    if not out["cols_match"]:
        out["spark_cols"], out["duck_cols"] = s_cols, d_cols
        out["match"] = False
        return out
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    out["match"] = a == b
    if not out["match"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = [x for x in a if x not in sb][:3]
        out["only_duck"] = [x for x in b if x not in sa][:3]
        out["cols"] = sorted(s_cols)
    return out


def main(argv):
    from spendlabel.session import get_spark
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark()
    import __spark_entry__ as E
    names = argv or sorted(E.queries())
    con = duck_connect(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": f"{type(e).__name__}: {str(e)[:600]}"}
        ok = r.get("match", r.get("oracle") == "none") and r.get("types_match", True)
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + repr(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
