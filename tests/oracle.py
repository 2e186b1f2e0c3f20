"""Runs registered queries next to their SQL and compares the results."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


# Spark type names next to DuckDB's
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(name: str, df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want_columns, want = rows_of(columns, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    types = {c: t for c, t, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = {c: (t, types[c]) for c, t in df.dtypes if TYPES.get(t) != types[c]}
    if wrong:
        return f"types {wrong}"
    if got != want:
        first = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return f"{len(got)} rows, expected {len(want)}; first difference {first}"
    return ""


def main(sf_dir: str, *names: str) -> None:
    root = Path(__file__).resolve().parent.parent
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    con = connection(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(name, build(spark, sf_dir), con, sql[name])
            else:
                problem = f"no SQL, {build(spark, sf_dir).count()} rows"
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{name:28s} {time.time() - start:6.2f} {problem or 'ok'}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
