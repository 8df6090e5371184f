"""Compare every query with its SQL on one data folder: ``python -m workload.check DIR [names]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from revtally.session import build_session
from workload import catalog

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _rows(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None when the rows agree, else what differs."""
    df = catalog.QUERIES[name](spark, sf_dir)
    mine = _rows(df.columns, df.collect())
    if name not in catalog.ORACLES:
        return None
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    theirs = _rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not mine:
        return "no rows"
    if mine != theirs:
        diff = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
        return f"{len(mine)} rows, {len(theirs)} expected; first differences {diff}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "check",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": 8,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or list(catalog.QUERIES):
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the other queries
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
