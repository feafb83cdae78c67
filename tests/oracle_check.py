"""Run registered queries next to their SQL and compare whole results.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def normalized(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, name: str, fn, sql: str | None) -> tuple[str, float, int]:
    begin = time.time()
    df = fn(spark, sf)
    got = normalized(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - begin
    if sql is None:
        return "rows-only", took, len(got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = normalized(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}", took, len(got)
    if len(got) != len(want):
        return f"row count {len(got)} / {len(want)}", took, len(got)
    for a, b in zip(got, want):
        if a != b:
            return f"first difference:\n   spark {str(a)[:700]}\n   sql   {str(b)[:700]}", took, len(got)
    types = {d[0]: str(d[1]) for d in cur.description}
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    off = [f"{f.name}: {f.dataType.simpleString()} / {types[f.name]}" for f in df.schema if kinds.get(f.dataType.simpleString(), "?") != types[f.name]]
    return ("ok" if not off else "type differs " + "; ".join(off)), took, len(got)


def main() -> int:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at : at + 2]
    from chatloom.plans import all_oracles, all_queries
    from chatloom.session import local_session

    spark = local_session(8)
    con = connect(sf)
    queries, oracles = all_queries(), all_oracles()
    bad = 0
    for name in args or queries:
        try:
            verdict, took, n = compare(spark, con, sf, name, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict, took, n = f"{type(e).__name__}: {str(e)[:1500]}", 0.0, 0
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:28s} {took:6.2f}s {n:8d} rows  {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
