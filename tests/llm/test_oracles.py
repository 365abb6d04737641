"""The SQL of the queries of this subpackage gives their rows, over the smallest tables."""

import duckdb
import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    rows = lambda names, values: sorted((tuple(r[names.index(c)] for c in columns) for r in values), key=repr)
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())
