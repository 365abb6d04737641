"""Every query of the catalogue equals its SQL on DuckDB, over the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalogue, crawl_queries, flow_queries, harvest_queries, lead_queries, run_queries, source_queries  # noqa: F401  (registers its queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(flat(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got, want = df.collect(), duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())
