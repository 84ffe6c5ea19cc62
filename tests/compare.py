"""Run registered queries and their SQL on the same tables and compare all values.

    python tests/compare.py [--sf sf0.01] [query ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, int):
        return value
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    spark_rows = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(spark_rows) != len(want):
        return f"{len(spark_rows)} rows != {len(want)}"
    if not want:
        return "no rows to compare"
    bad = [(a, b) for a, b in zip(spark_rows, want) if a != b]
    return f"{len(bad)} of {len(want)} rows differ, first: {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from laborlens.session import build_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    sf_dir = f"/root/testdata/{opts.sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.ui.enabled": "false",
                                                "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, fn in entry.queries().items():
        if opts.names and name not in opts.names:
            continue
        start = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            df = fn(spark, sf_dir)
            note = compare(df, con, sql) if sql else f"rows only: {len(df.collect())}"
        except Exception as error:
            note = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        ok = note is None or note.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print("failed:", failed)
