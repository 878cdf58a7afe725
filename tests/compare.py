"""Run registered queries next to their SQL in DuckDB and compare names, types and rows."""

from __future__ import annotations

import datetime
import math
import os
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return repr(float(v)) if False else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_value(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_value(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


KINDS = {"bigint": "int", "int": "int", "integer": "int", "string": "str", "varchar": "str", "double": "float", "boolean": "bool",
         "timestamp": "ts", "timestamp_ntz": "ts", "date": "date", "hugeint": "HUGE", "decimal": "DEC", "smallint": "int", "uinteger": "int"}


def kind(t: str) -> str:
    t = t.lower()
    return "list" if t.endswith("[]") or t.startswith("array") else KINDS.get(t.split("(")[0], t)


def compare(spark, con, query, sql, sf):
    """None when equal, else what differs."""
    df = query(spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if cols != sorted(rel.columns):
        return f"columns {cols} != {sorted(rel.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    off = [(c, dict(df.dtypes)[c], types[c]) for c in cols if kind(dict(df.dtypes)[c]) != kind(types[c])]
    if off:
        return f"types {off}"
    order = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(_value(r[i]) for i in order) for r in rel.fetchall())
    got = sorted(tuple(_value(r[c]) for c in cols) for r in df.collect())
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} != {len(want)}; columns {cols}; spark only {only_got}; sql only {only_want}"
    return None if got else "EMPTY"


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from sheaf.session import local_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark, con = local_session(8), connect(sf)
    names = sys.argv[1:]
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in q:
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            if name in o:
                why = compare(spark, con, q[name], o[name], sf)
            else:
                n = q[name](spark, sf).count()
                why = None if n else "EMPTY"
                print(f"      rows only: {n}")
        except Exception as ex:  # noqa: BLE001
            why = f"{type(ex).__name__}: {str(ex)[:1500]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - t:.1f}s {'' if why is None else why[:1800]}", flush=True)
    print("failures:", bad)
