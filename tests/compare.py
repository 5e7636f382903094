"""Run registered queries next to their SQL twins: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(arrow):
    names = sorted(arrow.column_names)
    columns = [arrow[n].to_pylist() for n in names]
    return names, {n: str(arrow.schema.field(n).type) for n in names}, sorted(zip(*columns), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """(problem or None, Spark rows, Spark seconds, SQL seconds)."""
    start = time.time()
    got = rows_of(fn(spark, sf_dir).toArrow())
    spark_s = time.time() - start
    if sql is None:
        return None, got, spark_s, 0.0
    start = time.time()
    want = rows_of(con.execute(sql).to_arrow_table())
    sql_s = time.time() - start
    problem = None
    if got[0] != want[0]:
        problem = f"columns {got[0]} vs {want[0]}"
    elif {k: v.replace("large_", "") for k, v in got[1].items()} != {k: v.replace("large_", "") for k, v in want[1].items()}:
        problem = f"types {got[1]} vs {want[1]}"
    if got[0] == want[0] and got[2] != want[2]:
        extra = [r for r in got[2] if r not in set(want[2])][:2]
        missing = [r for r in want[2] if r not in set(got[2])][:2]
        problem = f"{problem or ''} rows {len(got[2])} vs {len(want[2])}; only Spark {str(extra)[:700]}; only SQL {str(missing)[:700]}"
    return problem, got, spark_s, sql_s


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from articleflow.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    session = local_session("compare", 8, **{"spark.ui.showConsoleProgress": "false"})
    con, oracles, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        try:
            problem, got, spark_s, sql_s = compare(session, con, fn, oracles.get(name), sf_dir)
            verdict = "ok  " if problem is None else "DIFF"
            kind = "" if name in oracles else " (rows only)"
            print(f"{verdict} {name:26s} {len(got[2]):8d} rows  spark {spark_s:6.1f}s  sql {sql_s:6.1f}s{kind}", flush=True)
            if problem:
                print("     ", problem, flush=True)
        except Exception as error:  # report and go on with the next query
            problem = error
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
        bad += problem is not None
    sys.exit(bad > 0)
