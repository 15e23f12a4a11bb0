import numpy as np
import pytest
from pyspark.sql import functions as F

from nucleogrid.functions import geometry as G
from nucleogrid.operators import classes, identity, regions, series, spatial, statistics as S
from nucleogrid.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_voxel_rounding_is_half_even_and_never_negative(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.0,)], "c double").select(G.voxel_rounded(F.col("c"), 1.0))
    assert [r[0] for r in df.collect()] == [0, 2, 2, 0]


def test_unravel_undoes_ravel(spark):
    df = spark.createDataFrame([(3, 4, 5)], "z long, y long, x long").select(G.ravel([F.col(c) for c in "zyx"], [10, 10, 10]).alias("i"))
    assert tuple(df.select(*G.unravel(F.col("i"), [10, 10, 10])).first()) == (3, 4, 5)


def boxes(spark, prefix, data):
    return spark.createDataFrame(data, f"k int, {prefix}label int, " + ", ".join(f"{prefix}{a}{i} int" for a in "zyx" for i in (0, 1)))


def test_box_overlap_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(int(rng.integers(2)), i, *(int(v) for c in rng.integers(-20, 40, 3) for v in (c, c + rng.integers(1, 15)))) for i in range(n)]
    a, b = make(60), make(60)
    want = []
    for p in a:
        for q in b:
            if p[0] == q[0]:
                s = [min(p[3 + 2 * i], q[3 + 2 * i]) - max(p[2 + 2 * i], q[2 + 2 * i]) for i in range(3)]
                if min(s) > 0:
                    want.append((p[1], q[1]))
    got = spatial.overlapping_boxes(boxes(spark, "a_", a), boxes(spark, "b_", b), ["k"], 7.0).select("a_label", "b_label")
    assert rows(got) == sorted(want)


def test_touching_boxes_do_not_overlap(spark):
    a, b = boxes(spark, "a_", [(0, 1, 0, 2, 0, 2, 0, 2)]), boxes(spark, "b_", [(0, 2, 2, 4, 0, 2, 0, 2)])
    assert spatial.overlapping_boxes(a, b, ["k"], 2.0).count() == 0


def test_nearest_is_exact_also_far_away(spark):
    rng = np.random.default_rng(5)
    a = [(0, i, float(y), float(x)) for i, (y, x) in enumerate(rng.uniform(0, 900, (25, 2)))]
    b = [(0, i, float(y), float(x)) for i, (y, x) in enumerate(rng.uniform(0, 900, (30, 2)))]
    got = spatial.nearest(spark.createDataFrame(a, "k int, a_id int, a_y double, a_x double"), spark.createDataFrame(b, "k int, b_id int, b_y double, b_x double"), ["k"], 2, 20.0)
    want = [(i, j) for _, i, y, x in a for _, j in sorted(((y - v) ** 2 + (x - u) ** 2, j) for _, j, v, u in b)[:2]]
    assert rows(got.select("a_id", "b_id")) == sorted(want)


def test_merge_is_one_hop_and_sources_go_without_a_target(spark):
    objects = spark.createDataFrame([(0, 1, 2.0, 5), (0, 2, 4.0, 7), (0, 3, 6.0, 1), (0, 9, 0.0, 1)], "brain int, label int, z double, volume int")
    remap = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 9, 77)], "brain int, src int, dst int")
    assert rows(identity.merged_once(objects, remap, ["brain"], ["z"], ["volume"])) == [(0, 3, 5.0, 8)]


def test_good_fill_looks_back_then_ahead(spark):
    df = spark.createDataFrame([(1, 99.0), (2, 1.0), (3, 99.0), (4, 2.0)], "z int, t double").withColumn("p", F.lit(1))
    got = df.select("z", series.good_fill(F.col("t"), F.col("t") < 50, ["p"], "z"))
    assert rows(got) == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0)]


def test_median3_is_the_lower_one_at_the_end(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 3.0)], "z int, v double").withColumn("p", F.lit(1))
    assert rows(df.select("z", series.median3_forward("v", ["p"], "z"))) == [(1, 3.0), (2, 1.0), (3, 3.0)]


def test_subtree_sums_do_not_mix_up_prefixes(spark):
    o = spark.createDataFrame([("997", "/997/"), ("8", "/997/8/"), ("85", "/997/85/"), ("9", "/997/8/9/")], "id string, path string")
    v = spark.createDataFrame([("9", 2), ("85", 5)], "id string, n int")
    assert rows(regions.subtree_sums(v, o, "n")) == [("8", 2), ("85", 5), ("9", 2), ("997", 7)]
    assert rows(regions.deepest(o).select("id")) == [("85",), ("9",)]


def test_t_pvalue_has_known_values(spark):
    df = spark.createDataFrame([(2.228139, 10.0), (0.0, 5.0), (12.7062, 1.0)], "t double, df double")
    got = [r[0] for r in df.select(S.t_pvalue("t", "df")).collect()]
    assert got == pytest.approx([0.05, 1.0, 0.05], abs=1e-5)


def test_bh_is_monotone_and_at_least_p(spark):
    df = spark.createDataFrame([(i, 1, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.2])], "id int, g int, p double")
    got = {r.id: r.q for r in S.with_bh(df, "p", ["g"], "id").collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])


def test_percentiles(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "g int, v double")
    assert S.percentile_nearest_rank(df, "v", ["g"], 0.5).first().p == 2.0
    assert S.percentile_half_sample(df, "v", ["g"], 0.5).first().p == 2.5


def test_expressions_from_users_are_checked():
    with pytest.raises(ValueError):
        classes.formula("CT1; drop table x", ["CT1"])
    with pytest.raises(ValueError):
        classes.threshold("2*banana", "v")


def test_samplesheet_defaults_and_errors(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("brain,pair,tile_x,tile_y,tile_dir,image_dir,device\nb1,,,1,/t,,\n")
    assert tuple(readers.samplesheet(spark, str(p)).first())[:5] == ("b1", "pair", 0, 1, "/t")
    p.write_text("brain,pair,tile_x,tile_y,tile_dir,image_dir,device\n,x,0,1,/t,,\n")
    with pytest.raises(Exception, match="brain is missing"):
        readers.samplesheet(spark, str(p)).collect()


def test_transforms_come_back_from_json(spark, tmp_path):
    t = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0), (0, 1, 4.0, 5.0, 6.0)], "i int, j int, tz double, tx double, ty double")
    writers.transforms_json(t).coalesce(1).write.text(str(tmp_path / "t"))
    assert rows(readers.coarse_transforms(spark, str(tmp_path / "t"))) == rows(t)


def test_upsert_leaves_known_paths(spark):
    known, new = spark.createDataFrame([("a", 1)], "path string, size int"), spark.createDataFrame([("a", 9), ("b", 2), ("b", 3)], "path string, size int")
    assert rows(writers.upserted(known, new, "path")) == [("a", 1), ("b", 2)]


def test_complete_groups_drop_partial_values(spark):
    df = spark.createDataFrame([(5, 1), (5, 2), (6, 1), (7, 1), (7, 2)], "z int, tile int")
    assert rows(series.complete_only(df, "z", "tile").select("z", "rebased").distinct()) == [(5, 1), (7, 3)]
