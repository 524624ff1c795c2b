"""Plans of joins on exploded layers: no table goes through the driver, however small Spark takes it for."""

import pytest

from loomgrid.operators import seeds, spatial
from loomgrid.plans.queries import QUERIES


@pytest.fixture
def plans(monkeypatch):
    """Executed plans of all tables cut by checkpoints."""
    seen, cut = [], spatial.checkpointed

    def noted(df):
        out = cut(df)
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    for module in (seeds, spatial):
        monkeypatch.setattr(module, "checkpointed", noted)
    return seen


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = [(k, 1 + k * 7 % 50, float(1 + k * 31 % 97)) for k in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return folder


def check(spark, plans, folder, name):
    out = QUERIES[name](spark, folder)
    rows = out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1 and any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
    return rows


def test_block_seeds(spark, plans, parts):
    got = check(spark, plans, parts, "a6_a7_block_seeds")
    assert sorted(int(r.scene) for r in got) == list(range(1, 401))


def test_scene_dedup(spark, plans, parts):
    got = check(spark, plans, parts, "v8_j10_scene_dedup")
    score = lambda k: 1 + k * 31 % 97
    # Of the two discs k and k + 50 of an even pair the better one stays, of equals the first.
    want = {k for k in range(400) if k // 100 % 2 == 1 or k == min((k // 100 * 100 + k % 50, k // 100 * 100 + k % 50 + 50), key=lambda i: (-score(i), i))}
    assert {r.id for r in got} == want and len(got) == len(want)


def test_block_polygons(spark, plans, parts):
    got = check(spark, plans, parts, "a8_block_polygons")
    assert sorted(int(r.scene) for r in got) == list(range(1, 401)) and {r.corners for r in got} == {5}
