"""Compare a registered query with its DuckDB SQL, as sorted rows with columns by name."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        con.execute("SET TimeZone='UTC'")
        for t in TABLES:
            path = f"{sf_dir}/{t}.parquet"
            if os.path.exists(path):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
        got = con.execute(sql)
        return [c[0] for c in got.description], got.fetchall()


def _canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def differences(df, sf_dir: str, sql: str, limit: int = 3) -> list:
    names, rows = duck(sf_dir, sql)
    mine = _canonical(df.columns, [tuple(r) for r in df.collect()])
    theirs = _canonical(names, rows)
    found = [] if sorted(df.columns) == sorted(names) else [("columns", sorted(df.columns), sorted(names))]
    if len(mine) != len(theirs):
        found.append(("count", len(mine), len(theirs)))
    found += [(a, b) for a, b in zip(mine, theirs, strict=False) if repr(a) != repr(b) and a != b][:limit]
    return found
