"""Run registered queries beside their SQL and compare rows exactly."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, run, sql: str) -> str:
    """An empty string when both sides agree, else what differs."""
    df = run(spark, folder)
    left = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    right = rows_of(columns, found.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        return f"{len(different)} of {len(left)} rows differ, first: {different[0]}"
    types = [(c, type(a), type(b)) for c, a, b in zip(sorted(columns), left[0], right[0]) if a is not None and b is not None and type(a) is not type(b)] if left else []
    return f"types {types}" if types else ""


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    from tests.session import local_session

    spark, con = local_session(), duck(folder)
    runs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(runs):
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, folder, runs[name], sql[name])
            else:
                problem = "" if runs[name](spark, folder).count() >= 0 else "?"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{name:28s} {time.time() - start:6.2f}s {'exact' if name in sql else 'rows '} {problem or 'ok'}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
