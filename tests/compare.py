"""Compare a Spark query with its SQL on the same tables."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rows = [tuple(row[i] for i in order) for row in cur.fetchall()]
    return [columns[i] for i in order], sorted(rows, key=repr)


def spark_rows(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    rows = [tuple(row[c] for c in columns) for row in frame.collect()]
    return columns, sorted(rows, key=repr)


def same(a, b) -> bool:
    """Equal values of equal type; floats within a relative 1e-9."""
    if isinstance(a, float) or isinstance(b, float):
        return type(a) is type(b) and abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return type(a) is type(b) and a == b
