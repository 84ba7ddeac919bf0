"""Comparison of a Spark result with a DuckDB result, whatever the order of rows and columns."""


def one(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return "null"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(one, r)) for r in df.values.tolist())


def same(spark_df, duck, sql):
    a, b = spark_df.toPandas(), duck.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    assert x == y
