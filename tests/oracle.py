"""Side-by-side check of registered queries against their DuckDB SQL."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


_FAMILY = {"int": "int", "float": "float", "str": "str", "bool": "bool"}


def _family(rows, i):
    for row in rows:
        if row[i] is not None:
            return _FAMILY.get(type(row[i]).__name__, type(row[i]).__name__)
    return None


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, function, sql) -> tuple[str, float, int]:
    """(problem or "", Spark seconds, rows)."""
    started = time.time()
    df = function(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return "", seconds, len(rows)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", seconds, len(rows)
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}", seconds, len(rows)
    for name in names:
        left, right = _family(rows, df.columns.index(name)), _family(expected, names.index(name))
        if left and right and left != right:
            return f"type of {name}: {left} != {right}", seconds, len(rows)
    got, want = _rows(df.columns, rows), _rows(names, expected)
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ, e.g. {bad[:3]}", seconds, len(rows)
    return "", seconds, len(rows)
