"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return repr(value)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, folder) -> tuple[str, float, str]:
    start = time.time()
    df = run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return ("rows" if rows else "EMPTY"), took, f"{len(rows)} rows"
    expected = con.sql(sql)
    want = canonical(expected.columns, expected.fetchall())
    got = canonical(df.columns, rows)
    if want == got:
        return ("ok" if rows else "EMPTY"), took, f"{len(rows)} rows"
    if want[0] != got[0]:
        return "COLUMNS", took, f"{got[0]} / {want[0]}"
    a, b = set(got[1]), set(want[1])
    return "DIFF", took, f"{len(got[1])} / {len(want[1])} rows; only here {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-compare-")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main(folder: str, wanted: list[str]) -> None:
    import __spark_entry__ as entry

    spark, con = session(), duck(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            state, took, note = compare(spark, con, name, run, oracle.get(name), folder)
        except Exception as problem:  # noqa: BLE001
            state, took, note = "ERROR", 0.0, f"{type(problem).__name__}: {str(problem)[:600]}"
        bad += state not in ("ok", "rows")
        print(f"{state:8}{took:7.1f}s  {name:32}{note[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
