"""Holds queries against their SQL twins in DuckDB, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import os
import re

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _cell(v: object) -> object:
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _cell(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return tuple((k, _cell(x)) for k, x in sorted(v.asDict().items()))
    return re.sub(r"\.0+$", "", str(v)) if v.__class__.__name__ == "Decimal" else v


def rows(columns: list[str], data: list) -> list:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_cell(r[k]) for k in order) for r in data), key=repr)


def mismatch(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    rel = connection(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, such as {bad[0]} in {sorted(names)}" if bad else ""
