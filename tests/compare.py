"""Runs registered queries against their SQL twins in DuckDB."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def differences(spark_df, con, sql: str) -> str | None:
    """None when names, row count and sorted values agree, else what differs."""
    cols = sorted(spark_df.columns)
    rows = [tuple(r) for r in spark_df.select(*cols).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    rows.sort(key=_key)
    want.sort(key=_key)
    for a, b in zip(rows, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(cols, a))} != {dict(zip(cols, b))}"
    return None


def main(names: list[str], sf_dir: str) -> int:
    from smeltry.catalog import all_queries, all_sql
    from smeltry.session import builder

    spark = builder("compare", "local").master("local[8]").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    sql = all_sql()
    for name, fn in all_queries().items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                diff = differences(df, con, sql[name])
                n = ""
            else:
                n = f"rows={df.count()} (no sql)"
                diff = None
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - t:.2f}s {n} {diff or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    sys.exit(1 if main(args, sf) else 0)
