"""Run registered queries next to their SQL and compare. Usage: oracle_check.py <sf> [query ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, sf, query, sql) -> str:
    """Empty when equal, else a short description of the difference."""
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return ""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return ""
    extra = [x for x in a if x not in set(b)][:3]
    missing = [x for x in b if x not in set(a)][:3]
    return f"rows {len(a)} vs {len(b)}; only spark {extra}; only sql {missing}; columns {sorted(names)}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from gridloom.session import build_session

    sf = f"/root/testdata/{sys.argv[1]}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf), oracle_sql(), 0
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf, query, oracles.get(name))
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem[:1500]}", flush=True)
    print("failures", bad)
