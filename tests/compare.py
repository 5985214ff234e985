"""A Spark result against DuckDB SQL over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(got, sql: str, sf: str) -> None:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = _rows(got.toPandas()), _rows(con.sql(sql).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind in "fiu" and y.dtype.kind in "fiu":
            fine = ((x - y).abs() <= 2e-5 * (1 + y.abs())) | (x.isna() & y.isna())
        else:
            fine = (x == y) | (x.isna() & y.isna())
        assert fine.all(), (c, x[~fine].head(3).tolist(), y[~fine].head(3).tolist())
