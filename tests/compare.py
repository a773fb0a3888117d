"""Runs registered queries against their SQL twins and compares all values.

As a script: ``python tests/compare.py <data folder> [query ...]``.
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    return value


def _kinds(rows) -> dict[int, set[str]]:
    kinds: dict[int, set[str]] = {}
    for row in rows:
        for i, value in enumerate(row):
            if value is not None:
                kinds.setdefault(i, set()).add(type(value).__name__)
    return kinds


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(picked, key=repr)


def differences(spark, connection, name: str, sf_dir: str) -> str | None:
    """None if the query and its SQL twin agree, else what differs."""
    ours = entry.queries()[name](spark, sf_dir)
    names, rows = _sorted(ours.columns, ours.collect())
    result = connection.execute(entry.oracle_sql()[name])
    want_names, want = _sorted([d[0] for d in result.description], result.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    if _kinds(rows) != _kinds(want):
        return f"types {_kinds(rows)} != {_kinds(want)}"
    for got, expected in zip(rows, want):
        if got != expected:
            bad = [(n, a, b) for n, a, b in zip(names, got, expected) if a != b]
            return f"values {bad}"
    return None


if __name__ == "__main__":
    from tests.conftest import build_session

    spark = build_session()
    folder, wanted = sys.argv[1], sys.argv[2:]
    connection = connect(folder)
    failed = 0
    for name in wanted or list(entry.queries()):
        if name not in entry.oracle_sql():
            print("ROWS", name, entry.queries()[name](spark, folder).count(), flush=True)
            continue
        started = time.time()
        try:
            found = differences(spark, connection, name, folder)
        except Exception as problem:  # noqa: BLE001
            found = f"{type(problem).__name__}: {str(problem)[:500]}"
        failed += found is not None
        print("OK  " if found is None else "DIFF", name, round(time.time() - started, 2), found or "", flush=True)
    print("failed:", failed)
