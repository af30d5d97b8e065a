"""Order-insensitive comparison of a Spark result with the SQL result over the same tables."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from stowline.workload.views import BASE_TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of_sql(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    return names, types, cur.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names, types, want = rows_of_sql(con, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    sql_types = dict(zip(names, types))
    for name, kind in df.dtypes:
        if kinds.get(kind, kind) != sql_types[name]:
            return f"type of {name}: {kind} != {sql_types[name]}"
    got = [tuple(r) for r in df.collect()]
    left, right = normal(df.columns, got), normal(names, want)
    if left == right:
        return None
    return (f"{len(got)} rows against {len(want)}; only here {list((left - right).items())[:3]}; "
            f"only there {list((right - left).items())[:3]}; columns {sorted(names)}")


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from stowline.session import local_session

    sf_dir = sys.argv[1]
    wanted = set(sys.argv[2:])
    spark = local_session(8, "compare")
    con = connect(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problem = compare(df, con, sqls[name]) if name in sqls else (None if df.count() >= 0 else "no rows")
            n = len(con.execute(sqls[name]).fetchall()) if name in sqls else f"{df.count()} (rows only)"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:900]}", "-"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
