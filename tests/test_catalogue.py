"""Catalogue queries on small tables against brute force."""

import numpy as np

from nucleogrid.plans import catalogue


def test_knn2_asks_for_every_point_of_the_first_tile(spark, tmp_path):
    rng = np.random.default_rng(8)
    orders = [(k, int(rng.integers(1, 9)), float(rng.integers(0, 5_000_000)) / 100) for k in range(1, 241)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    points = [(c % 4, k % 3, k, int(p // 100) % 500, k * 7919 % 500) for k, c, p in orders]
    want = []
    for brain, tile, a, y, x in points:
        if tile == 0:
            near = sorted(((y - v) ** 2 + (x - u) ** 2, b) for other, to, b, v, u in points if other == brain and to == 1)
            want += [(brain, a, b, float(d), r) for r, (d, b) in enumerate(near[:2], 1)]
    assert len({w[1] for w in want}) == 80
    assert sorted(map(tuple, catalogue.knn2(spark, str(tmp_path)).collect())) == sorted(want)
