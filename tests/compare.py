"""Run registered queries against their SQL: python tests/compare.py [name-part ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else repr(float(v))
        if isinstance(v, int) and not isinstance(v, bool):
            return repr(v)
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    """(ok, message) of one query."""
    df = fn(spark, sf_dir)
    cols, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(rows)} rows (no SQL)"
    rel = con.sql(sql)
    ocols, orows = canonical(rel.columns, rel.fetchall())
    if cols != ocols:
        return False, f"columns {cols} vs {ocols}"
    if rows != orows:
        mine, theirs = set(rows), set(orows)
        a, b = sorted(mine - theirs)[:3], sorted(theirs - mine)[:3]
        return False, f"{len(rows)} vs {len(orows)} rows; only spark: {a}; only sql: {b}"
    return True, f"{len(rows)} rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import catalog
    from citeframe.session import tuned

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = tuned(
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, wanted = oracle(sf), 0, sys.argv[1:]
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            ok, message = check(spark, con, sf, name, fn, catalog.ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:36s} {time.time() - t:6.2f}s {message[:1800]}", flush=True)
    print(f"{bad} failed")
