"""Compare registered queries with their SQL in DuckDB: names, types, row counts and values.

Usage: python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(table):
    names = sorted(table.column_names)
    columns = [[plain(x) for x in table.column(n).to_pylist()] for n in names]
    return names, Counter(zip(*columns)) if columns else Counter()


def family(t) -> str:
    text = str(t)
    return "string" if text in ("string", "large_string", "string_view") else text


def compare(spark_table, duck_table) -> list[str]:
    issues = []
    left = {f.name: family(f.type) for f in spark_table.schema}
    right = {f.name: family(f.type) for f in duck_table.schema}
    if left != right:
        issues.append(f"schema {left} != {right}")
        if set(left) != set(right):
            return issues
    if spark_table.num_rows != duck_table.num_rows:
        issues.append(f"rows {spark_table.num_rows} != {duck_table.num_rows}")
    names, a = rows_of(spark_table)
    _, b = rows_of(duck_table)
    if a != b:
        issues.append(f"values differ in {sum((a - b).values())} rows; columns {names}; "
                      f"spark {str(list((a - b))[:2])[:600]} duckdb {str(list((b - a))[:2])[:600]}")
    return issues


def check(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    left = fn(spark, sf_dir).toArrow()
    took = time.time() - start
    if sql is None:
        return [] if left.num_rows else ["no rows"], took, left.num_rows
    right = con.sql(sql).to_arrow_table()
    return compare(left, right), took, left.num_rows


def main(argv):
    import __spark_entry__ as entry
    from labelloom.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), []
    todo = entry.queries()
    names = argv[1:] or list(todo)
    for name in names:
        try:
            issues, took, n = check(spark, con, name, todo[name], sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            issues, took, n = [f"{type(e).__name__}: {str(e)[:900]}"], 0.0, -1
        mark = "ok  " if not issues else "FAIL"
        print(f"{mark} {name:28s} {took:6.2f}s {n:8d} rows {'sql' if name in sqls else 'rows-only'}", flush=True)
        for i in issues:
            print("     ", i, flush=True)
        if issues:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
