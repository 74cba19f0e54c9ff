"""Run registered queries next to their SQL equivalents in DuckDB and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TIMES: dict[str, float] = {}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    TIMES["spark"] = time.time() - start
    start = time.time()
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    TIMES["duckdb"] = time.time() - start
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    missing = {repr(w) for w in want} - {repr(g) for g in got}
    extra = {repr(g) for g in got} - {repr(w) for w in want}
    if missing or extra:
        return f"{len(extra)} rows differ\n  got  {min(extra)[:1500]}\n  want {min(missing)[:1500]}"
    for g, w in zip(got, want):
        if g != w or any(type(a) is not type(b) for a, b in zip(g, w) if None not in (a, b)):
            return f"\n  got  {str(g)[:1500]}\n  want {str(w)[:1500]}"
    return None if got else "no rows"


def main(sf_dir: str, names: list[str]) -> int:
    from leadloom.plans.catalogue import ORACLES, QUERIES
    from leadloom.session import local_session

    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8"})
    connection = duck(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                message = difference(frame, connection, ORACLES[name])
            else:
                message = None if frame.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            message = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {name} {time.time() - start:.1f}s "
              f"(spark {TIMES.get('spark', 0):.1f} duckdb {TIMES.get('duckdb', 0):.1f}) "
              f"{message or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
