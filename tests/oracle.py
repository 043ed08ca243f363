"""Compare a Spark query with its SQL on the same tables."""

import math

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(frame, connection, sql):
    """Empty text if both give the same rows, whatever their order."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {frame.columns} and {names}"
    ours, theirs = _rows(frame.columns, frame.collect()), _rows(names, result.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)} rows"
    unequal = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(unequal)} of {len(ours)} rows differ, first {unequal[0]}" if unequal else ""
