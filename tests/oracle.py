"""Runs queries beside their DuckDB counterparts."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def _rows(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


def difference(df, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs between a query and its SQL; empty if nothing does."""
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    mine, theirs = _rows(df.columns, df.collect()), _rows(names, found.fetchall())
    if mine != theirs:
        return f"{len(mine)} and {len(theirs)} rows, first {next(((a, b) for a, b in zip(mine, theirs, strict=False) if a != b), None)}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    want = {d[0]: kinds.get(str(d[1]), str(d[1])) for d in c.execute(sql).description}
    got = dict(df.dtypes)
    return "" if all(got[k] == want[k] for k in got) else f"types {got} and {want}"
