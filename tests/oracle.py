"""Compare registered queries with their SQL.

    python -m tests.oracle /root/testdata/sf0.01 [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return value
    return str(value)


def sql_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = [str(d[1]) for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted((tuple(normal(r[i]) for i in order) for r in result.fetchall()), key=repr)
    return [names[i] for i in order], [types[i] for i in order], rows


def spark_rows(df):
    names = sorted(df.columns)
    rows = sorted((tuple(normal(v) for v in r) for r in df.select(names).collect()), key=repr)
    return names, [dict(df.dtypes)[n] for n in names], rows


TYPES = {"int": "INTEGER", "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(df, con, sql):
    """Empty when names, types and rows agree; else what differs."""
    names, types, rows = spark_rows(df)
    sql_names, sql_types, expected = sql_rows(con, sql)
    if names != sql_names:
        return f"columns {names} != {sql_names}", len(rows)
    wrong = [(n, a, b) for n, a, b in zip(names, types, sql_types) if TYPES.get(a) != b]
    if wrong:
        return f"types {wrong}", len(rows)
    if rows != expected:
        extra = [r for r in rows if r not in set(expected)][:3]
        missing = [r for r in expected if r not in set(rows)][:3]
        return f"{len(rows)} rows != {len(expected)}\n  names {names}\n  extra {extra}\n  missing {missing}", len(rows)
    return "", len(rows)


def main(folder, *names):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from snapledger.session import build_session

    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in sql:
                problem, count = differences(df, con, sql[name])
            else:
                problem, count = "", df.count()
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28} {count:8} rows {time.time() - start:6.1f}s {problem}", flush=True)
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
