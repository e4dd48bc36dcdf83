"""Compare a query with its DuckDB SQL over the same Parquet files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(repr([str(v.tolist() if hasattr(v, "tolist") else v) for v in r]) for r in frame[cols].itertuples(index=False, name=None))


def assert_same(spark, con, sf_dir, query, sql):
    got, want = rows(query(spark, sf_dir).toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
