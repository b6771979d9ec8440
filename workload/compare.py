"""Runs queries and their SQL twins side by side.  ``python -m workload.compare [scale folder] [name ...]``"""

from __future__ import annotations

import faulthandler
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from workload import QUERIES, TWINS


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, dict):
        return tuple((str(k), _plain(v)) for k, v in sorted(value.items(), key=lambda kv: str(kv[0])))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark: SparkSession, con, folder: str, name: str) -> list[str]:
    """What differs between a query and its twin; empty when they agree."""
    df = QUERIES[name](spark, folder)
    got = _rows(df.columns, df.collect())
    if name not in TWINS:
        return []
    twin = con.execute(TWINS[name])
    columns = [c[0] for c in twin.description]
    want = _rows(columns, twin.fetchall())
    found = []
    if sorted(df.columns) != sorted(columns):
        found.append(f"columns {sorted(df.columns)} vs {sorted(columns)}")
    types = {c[0]: str(c[1]).upper() for c in twin.description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for column, kind in df.dtypes:
        if kind in same and types.get(column) != same[kind]:
            found.append(f"type of {column}: {kind} vs {types.get(column)}")
    if len(got) != len(want):
        found.append(f"{len(got)} rows vs {len(want)}")
    elif got != want:
        a, b = next((a, b) for a, b in zip(got, want) if a != b)
        found.append(f"first difference:\n   {str(a)[:700]}\n   {str(b)[:700]}")
    return found


def main() -> int:
    from foliomill.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    # Stop with a traceback rather than run on: no query may take minutes at these scales.
    faulthandler.dump_traceback_later(1200, exit=True)
    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connection(folder), 0
    for name in names:
        began = time.time()
        try:
            found = differences(spark, con, folder, name)
        except Exception as failure:  # noqa: BLE001 - report and go on
            found = [f"{type(failure).__name__}: {str(failure)[:900]}"]
        bad += bool(found)
        mark = "DIFF" if found else ("ok" if name in TWINS else "ok (no twin)")
        print(f"{mark:13} {name:24} {time.time() - began:6.2f}s", *found, sep="\n      " if found else " ", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
