"""Corpus queries beside their SQL on the smallest tables, and on tables without rows."""

from pathlib import Path

import pytest

from loomgrid.llm.queries import oracle_sql, queries
from tests.test_oracles import rows

DATA = Path("/root/testdata/sf0.001")
TABLES = ("documents", "pages", "benchmark", "labels")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


def sql(name: str, folder: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if Path(f'{folder}/{t}.parquet').is_file() else '/*.parquet'}')")
    return c.execute(oracle_sql()[name]).df()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    got, want = queries()[name](spark, str(DATA)).toPandas(), sql(name, str(DATA))
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert rows(got) == rows(want)


def test_urls_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DATA}/pages.parquet").limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries()["op1_url_filter"](spark, str(tmp_path))
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"] and got.count() == 0
