"""Run registered queries next to their SQL and report differences.

``python -m checks.compare [sf] [query ...]``
"""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"temp_directory": tempfile.mkdtemp(prefix="duck-"), "max_temp_directory_size": "4GB"})
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _rows(arrow):
    arrow = arrow.select(sorted(arrow.column_names))
    return sorted(map(repr, zip(*[c.to_pylist() for c in arrow.columns])))


def _types(arrow) -> dict[str, str]:
    same = {"large_string": "string"}
    return {f.name: same.get(str(f.type), str(f.type)) for f in arrow.schema}


def differences(spark: SparkSession, con, query, sql: str, sf_dir: str) -> list[str]:
    got, want = query(spark, sf_dir).toArrow(), con.sql(sql).to_arrow_table()
    out = []
    if _types(got) != _types(want):
        out.append(f"types {sorted(set(_types(got).items()) ^ set(_types(want).items()))}")
    if sorted(got.column_names) == sorted(want.column_names):
        a, b = _rows(got), _rows(want)
        if a != b:
            out.append(f"rows {len(a)} / {len(b)}; only Spark {sorted(set(a) - set(b))[:3]}; only SQL {sorted(set(b) - set(a))[:3]}")
    if got.num_rows == 0:
        out.append("no rows")
    return out


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, failed = session(), duck(sf_dir), 0
    for name, query in QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            found = differences(spark, con, query, ORACLE[name], sf_dir)
        except Exception as error:  # a report must go on to the next query
            found = [str(error)[:1500]]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {' | '.join(found)}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
