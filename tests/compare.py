"""Side-by-side runs of the registered queries and their SQL."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(row[i]) for i in at) for row in rows), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN"}


def difference(spark, con, sf, function, sql) -> str | None:
    """None if both give the same columns, types and rows, else what differs."""
    result = function(spark, sf)
    got = [tuple(row) for row in result.collect()]
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    want = cursor.fetchall()
    if sorted(result.columns) != sorted(names):
        return f"columns {sorted(result.columns)} / {sorted(names)}"
    for name, kind in result.dtypes:
        if KINDS.get(kind) != kinds[name]:
            return f"type of {name}: {kind} / {kinds[name]}"
    got, want = ordered(got, result.columns), ordered(want, names)
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"{mine} / {theirs}"
    return None if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf), entry.oracle_sql()
    for name, function in entry.queries().items():
        if only and name not in only:
            continue
        begun = time.time()
        try:
            problem = difference(spark, con, sf, function, sqls[name])
        except Exception as err:
            problem = f"{type(err).__name__}: {str(err)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - begun:.1f}s {problem or ''}", flush=True)
