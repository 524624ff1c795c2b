"""Registered queries beside their SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from loomgrid.plans.queries import ORACLES, QUERIES  # noqa: E402


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    text = lambda v: "null" if v is None or str(v) in ("<NA>", "nan", "None") else f"{v:.6g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["scene", "peaks", "highest"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
