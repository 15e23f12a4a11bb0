"""Operators on objects, voxels and series against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nucleogrid.operators import cells, classes, identity, series, spatial, statistics as S


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_one_to_one_is_greedy(spark):
    rng = random.Random(3)
    pairs = [(a, b, rng.randrange(6)) for a in range(9) for b in range(7) if rng.random() < 0.6]
    left, want = sorted(pairs, key=lambda p: (-p[2], p[0], p[1])), []
    while left:
        want.append(left[0])
        left = [p for p in left if p[0] != left[0][0] and p[1] != left[0][1]]
    df = spark.createDataFrame(pairs, "a int, b int, s int")
    assert rows(S.one_to_one(df, "a", "b", "s")) == sorted(want)
    assert S.one_to_one(df.limit(0), "a", "b", "s").count() == 0


def test_principal_axes_match_numpy(spark):
    rng = np.random.default_rng(1)
    points = rng.integers(0, 20, (40, 3)).tolist()
    df = spark.createDataFrame([(7, *p) for p in points], "label int, z int, y int, x int")
    got = cells.principal_axes(cells.second_moments(df, ["label"])).first()
    want = np.linalg.eigvalsh(np.cov(np.array(points).T, bias=True))[::-1]
    assert [got.m1, got.m2, got.m3] == pytest.approx(want.tolist())
    assert got.n == 40 and abs(np.dot(got.a1, got.a2)) < 1e-9


def test_user_thresholds(spark):
    v = [1.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    of = lambda text: classes.threshold_of(df, text, "v").first()[0]
    assert of("mad") == pytest.approx(np.mean(np.abs(np.array(v) - np.mean(v))))
    assert of("2*mean + median") == of("2*mean median") == pytest.approx(2 * 4 + 3)
    assert [of(f"prctile({p})") for p in (0, 12.5, 37.5, 50, 100)] == [1, 1, 2, 3, 9]
    with pytest.raises(ValueError):
        classes.threshold_of(df, "2*banana", "v")


def test_names_that_fit_a_pattern(spark):
    df = spark.createDataFrame([("T[01 x 12]",), ("T[1 x 2] ",), ("xT[01 x 02]",)], "name string")
    assert rows(cells.parsed(df, "name", "T[%02d x %02d]", ["a", "b"])) == [("T[01 x 12]", 1, 12)]


def test_combinations_are_ordered_by_positives(spark):
    got = cells.combinations(spark, 3).orderBy("class").collect()
    assert [r.positives for r in got] == sorted(sum(c) for c in itertools.product((0, 1), repeat=3))
    assert len({r.code for r in got}) == 8


def test_unique_join_and_lists_refuse_what_is_not_there(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, image string")
    assert rows(cells.unique_join(a.filter("k = 1"), b, ["k"])) == [(1, "x")]
    with pytest.raises(Exception, match="not one row of"):
        cells.unique_join(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="on no list"):
        cells.split_by_list(a, spark.createDataFrame([(1, "train")], "k int, part string"), "k").collect()


def test_fills_reach_both_ends(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 7.0), (5, None)], "z int, v double").withColumn("tile", F.lit(0))
    fill = lambda f: [r[0] for r in df.select("z", f(F.col("v"), F.col("v").isNotNull(), ["tile"], "z").alias("o")).orderBy("z").select("o").collect()]
    assert fill(series.good_fill) == [5, 5, 5, 7, 7]
    assert fill(series.back_fill) == [5, 5, 7, 7, 7]


def test_logarithm_of_zero_counts_as_zero(spark):
    df = spark.createDataFrame([(0, 1, 0.0), (0, 2, 5.0), (0, 3, 0.0)], "t int, z int, v double")
    got = [r[0] for r in df.select("z", series.log_step(F.col("v"), ["t"], "z").alias("s")).orderBy("z").select("s").collect()]
    assert got[:2] == pytest.approx([np.log(5), -np.log(5)]) and got[2] is None


def test_dependent_adjustment_multiplies_by_the_harmonic_sum(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate((0.01, 0.02, 0.03))], "g int, i int, p double")
    plain, dependent = ([r.q for r in S.with_bh(df, "p", ["g"], "i", dependent=x).orderBy("i").collect()] for x in (False, True))
    assert plain == pytest.approx([0.03] * 3)
    assert dependent == pytest.approx([0.03 * (1 + 1 / 2 + 1 / 3)] * 3)


def test_a_box_is_judged_by_its_best_target_only(spark):
    boxes = spark.createDataFrame([(0, 0, 1, 5.0), (0, 0, 2, 9.0), (0, 0, 3, 1.0), (0, 1, 4, 7.0), (0, 1, 5, 1.0)], "brain int, tile int, label int, far double")
    pairs = spark.createDataFrame([(0, 1, 4, 0.3), (0, 2, 4, 0.2)], "brain int, a_label int, b_label int, iou double")
    assert rows(identity.suppressed_adaptive(pairs, boxes, 0.1)) == [(0, 4)]
    assert rows(identity.suppressed_adaptive(pairs, boxes, 10.0)) == []


def test_best_targets_without_a_table_of_pairs(spark):
    rng = np.random.default_rng(13)
    low, size = rng.integers(0, 30, (150, 3)), rng.integers(0, 7, (150, 3))
    size[:4] = 19  # longer than a block
    low[100:120], size[100:120] = low[80:100], size[80:100]  # copies of boxes, in the same tile or another
    data = [(0, int(t), i, float(rng.integers(0, 9)), *lo, *hi) for i, (t, lo, hi) in enumerate(zip(rng.integers(0, 4, 150), low.tolist(), (low + size).tolist()))]
    want = {}
    for m in data:
        for t in data:
            shared = np.prod([min(m[7 + c], t[7 + c]) - max(m[4 + c], t[4 + c]) if min(m[7 + c], t[7 + c]) > max(m[4 + c], t[4 + c]) else 0 for c in range(3)])
            if t[1] < m[1] and shared > 0:
                iou = shared / (np.prod(size[m[2]]) + np.prod(size[t[2]]) - shared)
                want[m[2], t[1]] = max(want.get((m[2], t[1]), (0.0, 0)), (iou, -t[2]))
    names = ["z0", "y0", "x0", "z1", "y1", "x1"]
    far = {r[2]: r[3] for r in data}
    for kind, cell in (("double", 96.0), ("long", 8.0)):
        boxes = spark.createDataFrame([(*r[:4], *map(float if kind == "double" else int, r[4:])) for r in data], f"brain int, tile int, label long, far double, {', '.join(f'{c} {kind}' for c in names)}")
        got = spatial.best_targets(boxes, cell).collect()
        assert len(got) == len(want) and {(r.m.label, r.t.tile): (r.iou, -r.t.label) for r in got} == want
        assert all((r.m.far, r.t.far) == (far[r.m.label], far[r.t.label]) for r in got)
    pairs = spark.createDataFrame([(0, -t, m, float(iou)) for (m, _), (iou, t) in want.items()], "brain int, a_label long, b_label long, iou double")
    gone = rows(identity.suppressed_adaptive(pairs, boxes, 0.1))
    assert gone and rows(identity.suppressed_among(boxes, 0.1, 8.0)) == gone


def test_chunks_own_each_row_once(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "z")
    got = cells.in_chunks(df, "z", 40, 10, 3).collect()
    assert sorted(r.z for r in got if r.own) == list(range(100))
    assert {(r.z, r.chunk) for r in got} == {(z, c) for z in range(100) for c in range(3) if c * 30 <= z < c * 30 + 40}
