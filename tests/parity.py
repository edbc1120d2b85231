"""Compare the registered queries with their SQL twins on one data folder."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, build, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    result = con.execute(sql)
    sql_columns, sql_rows = [x[0] for x in result.description], result.fetchall()
    df = build(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    left, right = _rows(df.columns, rows), _rows(sql_columns, sql_rows)
    if left == right:
        return None if left else "EMPTY"
    only_l = [x for x in left if x not in set(right)][:2]
    only_r = [x for x in right if x not in set(left)][:2]
    return f"rows {len(left)} vs {len(right)}; spark {str(only_l)[:700]} sql {str(only_r)[:700]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from deskweave.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("parity", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(folder), 0
    sqls = entry.oracle_sql()
    for key, build in entry.queries().items():
        if wanted and key not in wanted:
            continue
        start = time.time()
        try:
            if key in sqls:
                problem = compare(spark, con, folder, build, sqls[key])
            else:
                problem = None if build(spark, folder).count() else "EMPTY"
        except Exception as failure:
            problem = f"{type(failure).__name__}: {str(failure)[:900]}"
        bad += problem is not None
        print(f"{key:28s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}{'' if key in sqls else ' (rows only)'}", flush=True)
    print("bad:", bad)
    spark.stop()
