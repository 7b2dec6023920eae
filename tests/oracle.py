"""Compares a query with its SQL in DuckDB, as sorted rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same(spark, con, sf_dir, query, sql):
    got = query(spark, sf_dir)
    cols = sorted(got.columns)
    want = con.execute(sql).to_arrow_table()
    assert sorted(want.column_names) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(r[c] for c in cols) for r in want.to_pylist()), key=key)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    return len(a)
