"""Run registered queries in Spark and their SQL in DuckDB and compare."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty text when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "", len(got)
    res = con.execute(sql)
    types = {d[0]: str(d[1]) for d in res.description}
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    spark_types = dict(df.dtypes)
    expected = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "date": "DATE"}
    wrong = {c: (spark_types[c], types[c]) for c in got_cols if expected.get(spark_types[c], spark_types[c]) != types[c]}
    if wrong:
        return f"types {wrong}", len(got)
    if got != want:
        extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return f"{got_cols}: rows {len(got)}/{len(want)}; only spark {extra[:3]}; only oracle {missing[:3]}", len(got)
    return "", len(got)


def main():
    import __spark_entry__ as entry
    from palisade.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = build_session(master=os.environ.get("COMPARE_MASTER", "local[8]"), **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n.startswith(a) for a in args.names)]
    failed = []
    for name in names:
        start = time.time()
        try:
            problem, n = compare(spark, con, name, queries[name], oracles.get(name), args.sf)
        except Exception as exc:  # report and go on with the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name} rows={n} {time.time() - start:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names)} queries, {len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
