"""Runs registered queries against their SQL twins and reports differences."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0):
        return v.date()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        only = [r for r in got[1] if r not in set(want[1])][:2], [r for r in want[1] if r not in set(got[1])][:2]
        return f"rows {len(got[1])} != {len(want[1])}; {only}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[:2]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from casewell.settings import default_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = default_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            if name in sql:
                result = difference(queries[name](spark, sf_dir), con, sql[name]) or "ok"
            else:
                result = f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as e:  # report and go on
            result = f"ERROR {str(e)[:600]}"
        print(f"{name}: {result} ({time.time() - start:.1f}s)", flush=True)
