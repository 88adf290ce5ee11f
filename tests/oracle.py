"""Runs a registered query and its SQL over the same Parquet tables and compares all rows."""

import os
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TIDELOG_DATA", "/root/testdata/sf0.001"))


def connect(folder=DATA):
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, folder=DATA):
    frame = query(spark, str(folder))
    got = rows_of(frame.columns, frame.collect())
    found = connect(folder).execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    assert sorted(frame.columns) == sorted(names)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
