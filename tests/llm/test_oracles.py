import duckdb
import pytest

from itemforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(repr(tuple(r[names.index(k)] for k in columns)) for r in found.fetchall())
    assert sorted(names) == columns and sorted(repr(tuple(r[k] for k in columns)) for r in df.collect()) == want
