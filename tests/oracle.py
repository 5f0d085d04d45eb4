"""Compare registered queries with their SQL: ``python -m tests.oracle [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    """Values of both engines in one form."""
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """A description of the first difference, or None."""
    df = query(spark, sf_dir)
    ours = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(plain(row[df.columns.index(n)]) for n in order) for row in ours), key=repr)
    b = sorted((tuple(plain(row[names.index(n)]) for n in order) for row in theirs), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"\n  {str(x)[:600]}\n  {str(y)[:600]}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from ebbmark.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracle:
                result = compare(spark, con, queries[name], oracle[name], sf_dir) or "ok"
            else:
                result = f"rows only: {len(queries[name](spark, sf_dir).collect())}"
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:32s} {time.time() - start:6.1f}s {result}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
