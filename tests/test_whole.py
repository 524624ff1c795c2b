"""Queries over whole layers against brute force, on layers beyond those of the smallest tables."""

import random

import pytest

from loomgrid.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    """Folder, orders and parts; the orders fill 70 rows, with one tall component across row 30."""
    folder, rng = str(tmp_path_factory.mktemp("layers")), random.Random(5)
    orders = []
    for key in range(3500):
        tall = key % 50 == 7 and 20 <= key // 50 < 60
        if tall or rng.random() < 0.4:
            orders.append((key, "O" if tall else rng.choice("FOP"), 400000.0 if tall else rng.random() * 500000))
    parts = [(key, rng.randrange(1, 51), 1.0, "b") for key in range(1, 3300, 7)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double, p_brand string").write.parquet(f"{folder}/part.parquet")
    return folder, orders, parts


def test_components(spark, layers):
    folder, orders, _ = layers
    todo = {divmod(k, 50) for k, status, price in orders if status == "O" and price / 500000 > 0.3}
    want = {}
    for start in sorted(todo):
        front = [start] if start not in want else []
        while front:
            y, x = front.pop()
            if (y, x) in todo and (y, x) not in want:
                want[y, x] = start
                front += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    got = QUERIES["a5_components"](spark, folder).collect()
    assert max(y for y, _ in want) > 60 and want[59, 7][0] < 30
    assert {(r.row, r.col): (r.first_row, r.first_col) for r in got} == want and len(got) == len(want)


def boxes(parts):
    for k, size, *_ in parts:
        x, y, side = float(k % 50), float(k // 50), 0.4 + size / 25
        yield k, x, y, x + side, y + side


def test_burn(spark, layers):
    folder, orders, parts = layers
    want = {}
    for k, *_ in orders:
        y, x = divmod(k, 50)
        over = [i % 5 + 1 for i, x0, y0, x1, y1 in boxes(parts) if x0 <= x + 0.5 < x1 and y0 <= y + 0.5 < y1]
        want[y, x] = max(over, default=0) if x < 45 else 0
    got = {(r.row, r.col): r.mask for r in QUERIES["b1_burn"](spark, folder).collect()}
    assert got == want and any(m for (y, _), m in want.items() if y >= 40)


def test_candidates(spark, layers):
    folder, _, parts = layers
    tiles = list(boxes(parts))
    notes = [(i, x0 + 0.3, y0 + 0.3, x1 + 0.1, y1 + 0.1) for i, x0, y0, x1, y1 in tiles]
    want = sorted((t, i, i % 4) for t, a0, b0, a1, b1 in tiles for i, x0, y0, x1, y1 in notes if a0 <= x1 and a1 >= x0 and b0 <= y1 and b1 >= y0)
    got = QUERIES["j5_candidates"](spark, folder).collect()
    assert sorted((r.tile_id, r.annot_id, r.cls) for r in got) == want and any(i % 2 for _, i, _ in want)


def test_integrity_check(spark):
    from loomgrid.plans.integrity import integrity_check

    files = lambda *rows: spark.createDataFrame(rows, "split string, stem string")
    images = files(("train", "a"), ("train", "b"), ("train", "b"), ("val", "a"), ("other", "z"))
    masks = files(("train", "a"), ("val", "a"), ("val", "c"), ("val", "d"), ("test", "b"))
    tiles = [(1, "train", 0.0, 0.0, 2.0, 2.0), (2, "val", 2.0, 1.0, 4.0, 3.0), (3, "val", 1.0, 1.0, 3.0, 3.0), (4, "test", 9.0, 9.0, 11.0, 11.0), (5, "train", 8.0, 8.0, 9.5, 9.5), (6, "other", 0.0, 0.0, 9.0, 9.0)]
    got = integrity_check(images, masks, spark.createDataFrame(tiles, "tile_id long, split string, x0 double, y0 double, x1 double, y1 double"), 2.0)
    want = {("train", None, "image without mask", 1), ("val", None, "mask without image", 2), ("test", None, "mask without image", 1), ("train", "val", "overlap", 2), ("train", "test", "overlap", 1)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 5


def test_decide_ties(spark, tmp_path):
    import duckdb

    prices = [250000.0001, 250000.01, 249999.99, 250000.0, 249999.9999]
    spark.createDataFrame([(2 + k, "O", x) for k, x in enumerate(prices)], "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in QUERIES["a2_decide"](spark, str(tmp_path)).select("row", "col", "cls", "p").collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(c.execute(f"SELECT row, col, cls, p FROM ({ORACLES['a2_decide']})").fetchall())
    assert got == want and [r[2] for r in got] == [0, 1, 0, 0, 0]
