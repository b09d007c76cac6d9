"""Compare registered queries with their SQL on the driver tables: python tests/check_oracles.py [sf] [name-part ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return str(v)


def family(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "int", "integer", "long", "smallint", "tinyint"):
        return "int"
    if t in ("varchar", "string", "text"):
        return "str"
    return t


def compare(sdf, con, sql: str) -> str:
    rows = [tuple(rw) for rw in sdf.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: family(str(d[1])) for d in rel.description}
    orows = rel.fetchall()
    if sorted(names) != sorted(sdf.columns):
        return f"COLUMNS spark={sorted(sdf.columns)} sql={sorted(names)}"
    stypes = {f: family(t) for f, t in sdf.dtypes}
    bad = {c: (stypes[c], types[c]) for c in names if stypes[c] != types[c]}
    cols = sorted(names)
    si = [sdf.columns.index(c) for c in cols]
    oi = [names.index(c) for c in cols]
    a = sorted(tuple(canon(rw[i]) for i in si) for rw in rows)
    b = sorted(tuple(canon(rw[i]) for i in oi) for rw in orows)
    if len(a) != len(b):
        return f"ROWS spark={len(a)} sql={len(b)}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"VALUES {len(diff)}/{len(a)} differ cols={cols} first={diff[0][0]} vs {diff[0][1]}"
    if bad:
        return f"TYPES {bad}"
    return f"ok rows={len(a)}" if a else "EMPTY"


def main() -> None:
    import __spark_entry__ as entry
    from firmlens.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session("oracles", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failures = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            msg = compare(df, con, sqls[name]) if name in sqls else f"rows-only {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            msg = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        ok = msg.startswith(("ok", "rows-only"))
        failures += not ok
        print(f"{'  ' if ok else '! '}{name}: {msg} ({time.time() - t0:.1f}s)", flush=True)
    print("failures:", failures)


if __name__ == "__main__":
    main()
