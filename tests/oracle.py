"""Runs a registered query and its SQL on the same tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    done = con.execute(sql)
    return [c[0] for c in done.description], done.fetchall()


def canonical(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> int:
    names, want = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = df.collect()
    assert canonical(df.columns, got) == canonical(names, want)
    return len(got)
