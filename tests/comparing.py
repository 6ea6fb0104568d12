"""Rows of a Spark query and of its DuckDB SQL, in one form."""

from __future__ import annotations

import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value if isinstance(value, (int, bool)) else str(value)


def rows(columns: list[str], values) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(row[i]) for i in order]) for row in values)
