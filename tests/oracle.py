"""Run a query's SQL in DuckDB and compare the rows, whatever their order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def same(df, c, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want
