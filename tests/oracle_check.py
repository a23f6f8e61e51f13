"""Compare registered queries with their SQL: python tests/oracle_check.py [sf] [name...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from dqspark.session import local_session  # noqa: E402
from dqspark.workload.queries import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows {sum(got[1].values())}"
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS differ: {got[0]} / {want[0]}"
    if got[1] != want[1]:
        more, less = list((got[1] - want[1]).items())[:2], list((want[1] - got[1]).items())[:2]
        return f"ROWS differ: spark {sum(got[1].values())} sql {sum(want[1].values())}\n   spark {more}\n   sql   {less}"
    return f"ok {sum(got[1].values())}"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    session, duck = local_session("8"), connect(folder)
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for n in names:
        t = time.time()
        try:
            result = compare(session, duck, folder, n)
        except Exception as e:  # noqa: BLE001
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += result.startswith(("ROWS", "COL", "ERR"))
        print(f"{n:26s}{time.time() - t:6.1f}s  {result}", flush=True)
    print("failures:", bad, "missing queries:", sorted(set(entry.oracle_sql()) - set(entry.queries())))
