"""Holds a query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 9))
        return str(x)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, query, sql):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    want = rows_of(names, want.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]
    return len(got)
