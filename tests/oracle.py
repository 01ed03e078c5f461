"""Run a query and its DuckDB counterpart and compare names, types, and values regardless of order."""

from __future__ import annotations

import glob
import os

import duckdb

KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "double": "float", "string": "str", "boolean": "bool", "timestamp": "ts",
    "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "ts",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def differences(df, con, sql: str) -> list[str]:
    names = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    rel = con.sql(sql)
    theirs_names = sorted(rel.columns)
    if names != theirs_names:
        return [f"columns {names} != {theirs_names}"]
    types = dict(df.dtypes)
    theirs_types = dict(zip(rel.columns, map(str, rel.types)))
    out = [
        f"type of {n}: {types[n]} != {theirs_types[n]}"
        for n in names
        if KINDS.get(types[n], types[n]) != KINDS.get(theirs_types[n], theirs_types[n])
    ]
    at = [rel.columns.index(n) for n in names]
    theirs = [tuple(r[i] for i in at) for r in rel.fetchall()]
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    ours.sort(key=_key)
    theirs.sort(key=_key)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    return out
