"""Compares a query's rows with DuckDB's on the same Parquet tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        src = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def canon(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return sorted(cols), rows_of(cols, cur.fetchall())


def compare(df, con, sql):
    a, b = spark_rows(df), duck_rows(con, sql)
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    diff = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not diff, diff[:3]


def same_twice(spark, build):
    """The rows of two runs, the second with other partitions, must be the same, and there must be some."""
    first = spark_rows(build())
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        second = spark_rows(build())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert first[1] and len(set(first[0])) == len(first[0])
    assert first[0] == second[0] and len(first[1]) == len(second[1])
    diff = [(x, y) for x, y in zip(first[1], second[1]) if x != y]
    assert not diff, diff[:3]
