"""Compare a query with its SQL twin, without regard to row order."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings listing detail_raw document_v1 search_request search_result eval_item lang_sample abuse_sample container_spec".split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        path = Path(directory, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, directory, f, sql):
    df = f(spark, directory)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want), f"{len(got)} rows, {len(want)} in SQL"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, f"{len(bad)} of {len(got)} differ: {bad[:3]}"
    return len(got)
