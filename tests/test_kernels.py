"""Alignment, fitted classes, files and runs against plain Python."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nucleogrid.operators import alignment, learned, spatial
from nucleogrid.sources import rasters, runs, writers


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_translation_is_found_whatever_the_block(spark):
    rng = np.random.default_rng(4)
    y = rng.uniform(0, 80, (60, 3))
    x = y[:50] + [0, 3.0, -2.0]
    data = [(1, False, *p) for p in x.tolist()] + [(1, True, *p) for p in y.tolist()] + [(2, True, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "g int, moving boolean, z double, y double, x double")
    a, b = (alignment.translation(df, ["g"], block=n).orderBy("g").collect() for n in (7, 1000))
    assert (a[0].ty, a[0].tx) == pytest.approx((3, -2), abs=0.05) and (a[0].ty, a[0].tx) == pytest.approx((b[0].ty, b[0].tx), abs=1e-6)
    assert (a[1].ty, a[1].tx) == (0, 0)


def test_translation_counts_points_of_a_place_and_needs_no_pairs(spark):
    rng = np.random.default_rng(11)
    y = np.unique(rng.integers(0, (5, 40, 30), (3000, 3)).astype(float), axis=0)
    x = y[rng.permutation(len(y))[:2000]] + [0, 0.4, -0.3]
    n = rng.integers(1, 4, len(y)).astype(float)
    of = [(x, np.ones(len(x)), y, n)]
    pairs, axes = alignment._by_pairs(*of[0], 64), alignment._by_axes(*of[0])
    for variance in (200.0, 3.0, 0.01):
        a, b = pairs(np.array([0, 0.2, 0.1]), variance), axes(np.array([0, 0.2, 0.1]), variance)
        assert all(np.allclose(p, q, rtol=1e-8, atol=1e-9) for p, q in zip(a, b))
    copies = [(1, m, *p) for m, side in ((False, x), (True, y)) for p in side.tolist()]
    once, often = (alignment.translation(spark.createDataFrame(copies * k, "g int, moving boolean, z double, y double, x double"), ["g"]).collect()[0] for k in (1, 3))
    assert (once.ty, once.tx) == pytest.approx((0.4, -0.3), abs=0.02) and (often.ty, often.tx) == pytest.approx((once.ty, once.tx), abs=1e-3)


def test_phase_shift_finds_the_planted_move(spark):
    image = np.random.default_rng(2).uniform(0, 1, (9, 12))
    pixels = [(g, m, y, x, float(v)) for g, (dy, dx) in enumerate(((0, 0), (3, -4), (-4, 5))) for m, i in ((False, image), (True, np.roll(image, (-dy, -dx), (0, 1)))) for (y, x), v in np.ndenumerate(i)]
    df = spark.createDataFrame([*pixels, (9, True, 2, 2, 0.0)], "g int, moving boolean, y int, x int, v double")
    assert sorted(map(tuple, alignment.phase_shift(df, ["g"]).collect()), key=lambda r: r[0]) == [(0, 0, 0), (1, 3, -4), (2, -4, 5), (9, None, None)]


def test_low_pass_is_the_transform_under_the_mask(spark):
    image = np.random.default_rng(3).uniform(0, 1, (4, 5))
    got = alignment.low_pass(spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(image)], "g int, y int, x int, v double"), ["g"], 1.5).collect()
    want = np.zeros((4, 5), complex)
    for a, b in itertools.product(range(-2, 2), range(-2, 3)):
        wave = np.exp(2j * np.pi * (a * np.arange(4)[:, None] / 4 + b * np.arange(5)[None, :] / 5))
        want += (image * wave.conj()).sum() * np.exp(-(a * a + b * b) / (2 * 1.5**2)) * wave / 20
    assert {(r.y, r.x): pytest.approx(r.v) for r in got} == {k: v for k, v in np.ndenumerate(np.abs(want))}


def test_tree_takes_the_best_edges(spark):
    rng = np.random.default_rng(5)
    edges = [(i, j, down, float(rng.integers(-9, 9)), float(q)) for q, (i, j, down) in zip(rng.permutation(12), [(i, j, d) for i in range(3) for j in range(3) for d in (True, False) if (i if d else j)])]
    got = {(r.i, r.j): r.z for r in alignment.tree_offsets(spark.createDataFrame([(1, *e) for e in edges] + [(1, 7, 7, True, 1.0, None)], "g int, i int, j int, down boolean, z double, quality double"), ["g"]).collect()}
    ends = lambda e: ((e[0] - 1, e[1]) if e[2] else (e[0], e[1] - 1), (e[0], e[1]))
    best, weight = None, -1.0
    for some in itertools.combinations(edges, 8):
        place, grew = {(0, 0): 0.0}, True
        while grew:
            grew = False
            for e in some:
                a, b = ends(e)
                if (a in place) != (b in place):
                    place[b if a in place else a] = place[a] + e[3] if a in place else place[b] - e[3]
                    grew = True
        if len(place) == 9 and sum(e[4] for e in some) > weight:
            best, weight = place, sum(e[4] for e in some)
    top = max(best.values())
    assert got == {**{t: z - top + 1 for t, z in best.items()}, (6, 7): None, (7, 7): None}


def test_windows_grow_until_both_sides_have_points(spark):
    rng = np.random.default_rng(6)
    counts = [(g, z, int(rng.integers(0, 5)), int(rng.integers(0, 5))) for g in (1, 2) for z in range(g, 90)]
    want = []
    for g in (1, 2):
        of = lambda up, z, c: sum(r[c] for r in counts if r[0] == g and up <= r[1] < z)  # noqa: E731, B023
        z, size = 89, 4
        while z > g:
            up = max(0, z - size)
            m, t = of(up, z, 2), of(up, z, 3)
            if (m < 20 or t < 20) and m * t < 900 and up > 0:
                size += 4
            else:
                want.append((g, up, z, m, t, m > 0 and t > 0 and m * t < 900))
                z, size = z - size, 4
    got = alignment.point_windows(spark.createDataFrame(counts, "g int, z int, moving int, target int"), ["g"], 4, 20, 30)
    assert rows(got) == sorted(want)


def test_matches_are_the_nearest_and_one_to_one(spark):
    rng = np.random.default_rng(7)
    a, b = ([(1, i, float(y), float(x)) for i, (y, x) in enumerate(rng.integers(0, 40, (n, 2)))] for n in (50, 40))
    first = {}
    for _, i, y, x in a:
        near = min(((y - v) ** 2 + (x - u) ** 2, j) for _, j, v, u in b)
        if near[0] <= 25:
            first[i] = near
    want = {}
    for i, (d, j) in first.items():
        want[j] = min(want.get(j, (np.inf, 0)), (d, i))
    df = [spark.createDataFrame(p, f"k int, {n}_id int, {n}_y double, {n}_x double") for n, p in (("a", a), ("b", b))]
    assert rows(spatial.matched(*df, ["k"], 5).select("a_id", "b_id", "d2")) == sorted((i, j, d) for j, (d, i) in want.items())


def test_matches_make_no_pairs_of_all_that_are_near(spark):
    # 4,000 points on each side, all within the distance of each other: 16 million pairs
    rng = np.random.default_rng(12)
    a, b = (np.unique(np.round(rng.uniform(0, 8, (4000, 2)), 2), axis=0) for _ in "ab")
    df = [spark.createDataFrame([(1, i, *p) for i, p in enumerate([*side.tolist(), *side[:500].tolist()])] + [(1, 9999, None, 1.0), (None, 9998, 1.0, 1.0)], f"k int, {n}_id int, {n}_y double, {n}_x double") for n, side in (("a", a), ("b", b))]
    d2 = ((a[:, None] - b[None]) ** 2).sum(2)
    want = {}
    for i, j in enumerate(d2.argmin(1).tolist()):
        want[j] = min(want.get(j, (np.inf, 0)), (float(d2[i, j]), i))
    assert rows(spatial.matched(*df, ["k"], 15.0).select("a_id", "b_id")) == sorted((i, j) for j, (_, i) in want.items())
    seen, runs_of = [], spatial._runs
    spatial._runs = lambda start, n: seen.append(n.sum()) or runs_of(start, n)
    try:
        spatial._nearest_within(a, b, 15.0)
    finally:
        spatial._runs = runs_of
    assert sum(seen) < 100 * len(a)


def test_mixture_is_that_of_plain_em(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate((rng.normal(0, 1, 120), rng.normal(5, 0.7, 60)))
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)] + [(1, 900, None), (2, 901, 4.0)], "g int, id int, v double")
    x = np.clip((v - v.mean()) / v.std(ddof=1), -4, 4)
    w, m, s = np.full(2, 0.5), np.array([-1.0, 1.0]), np.ones(2)
    share = lambda: (p := w / np.sqrt(s) * np.exp(-((x[:, None] - m) ** 2) / (2 * s))) / p.sum(1, keepdims=True)
    for _ in range(8):
        r = share()
        n = r.sum(0)
        w, m = n / len(x), (r * x[:, None]).sum(0) / n
        s = (r * x[:, None] ** 2).sum(0) / n - m * m
    got = {r.id: r.p for r in learned.mixture(df, "g", "v", 2, steps=8, tolerance=0.0).collect()}
    assert got[900] is None and got[901] is None
    assert np.allclose(np.array([got[i] for i in range(len(v))]), share(), atol=1e-9)
    sure = spark.createDataFrame([([0.2, 0.8], False), ([0.2, 0.8], True), ([0.05, 0.95], True)], "p array<double>, off boolean")
    assert [r[0] for r in sure.select(learned.positive(F.col("p"), 0.5, F.col("off"))).collect()] == [True, False, True]


def test_rows_are_predicted_by_a_model_that_has_not_seen_them(spark):
    rng = np.random.default_rng(9)
    data = [(i, [float(x) for x in rng.normal(0, 1, 2) + (8 * (i % 2), 0)], "ab"[i % 2]) for i in range(60)]
    got = learned.one_vs_all(spark.createDataFrame([*data, (99, None, "a")], "id int, f array<double>, kind string"), "id", "f", "kind", 2, steps=5)
    assert {(r.label, r.predicted): r.n for r in learned.confusion(got).collect()} == {("a", "a"): 30, ("b", "b"): 30}


def test_volumes_come_back_from_files(spark, tmp_path):
    volume = np.random.default_rng(1).integers(0, 9, (3, 4, 2)).astype(float)
    df = spark.createDataFrame([("m", *map(int, k), float(v)) for k, v in np.ndenumerate(volume) if v], "name string, z int, y int, x int, v double")
    done = rasters.saved(rasters.nifti_files(df.withColumn("name", rasters.fused_name("cell count", F.lit("b1"), "c2", "-")), "name", (3, 4, 2)), str(tmp_path / "maps")).collect()
    assert [r.path for r in done] == [f"{tmp_path}/maps/fused-cell-count_b1_c2.nii.gz"]
    found = rasters.files(spark, str(tmp_path / "maps"), "*.nii.gz")
    for reverse in (False, True):
        back = {(r.z, r.y, r.x): r.v for r in rasters.nifti_voxels(found, reverse).collect()}
        want = volume.transpose(2, 0, 1)
        assert back == {k: v for k, v in np.ndenumerate(want[:, :, ::-1] if reverse else want)}
    with pytest.raises(Exception, match="lies outside"):
        rasters.nifti_files(df, "name", (2, 4, 2)).collect()
    with pytest.raises(ValueError):
        rasters.nifti_array(b"x" * 400)


def test_nrrd_of_both_encodings(spark):
    import gzip

    volume = np.array([[[1, 1000], [3, -4]]], np.int16)
    head = lambda coding, end: f"NRRD0004\ntype: short\ndimension: 3\nsizes: 1 2 2\nendian: {end}\nencoding: {coding}\n\n".encode()
    data = [("a", head("raw", "big") + volume.astype(">i2").tobytes(order="F")), ("b", head("gzip", "little") + gzip.compress(volume.astype("<i2").tobytes(order="F")))]
    got = rows(rasters.nrrd_voxels(spark.createDataFrame(data, "path string, content binary")))
    assert got == [(p, 0, y, x, v) for p in "ab" for y, x, v in ((0, 0, 1.0), (0, 1, 0.0), (1, 0, 3.0), (1, 1, -4.0))]


def test_array_headers(spark, tmp_path):
    np.save(tmp_path / "0_5_1_7_2_9.npy", np.zeros((5, 6, 7)))
    (tmp_path / "bad.npy").write_bytes(b"no array")
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("0_5_1_7_2_9.npy", "bad.npy", "none.npy")], "path string")
    assert sorted((tuple(r.shape or ()), tuple(r.place)) for r in rasters.array_headers(paths).collect()) == [((), (0,) * 6), ((), (0,) * 6), ((5, 6, 7), (0, 5, 1, 7, 2, 9))]


def test_logs_annotations_and_projects(spark):
    log = "a\nb\nSat Feb  3 23:00:00 2024\nc\nMon Feb  5 01:30:00 2024\nd\n{}\n"
    got = runs.run_logs(spark.createDataFrame([("ok", log.format("ok")), ("bad", log.format("no")), ("short", "ok\n")], "path string, value string")).collect()
    assert [(r.path, r.hours) for r in got] == [("ok", 2.5)]
    assert rows(runs.annotations(spark.createDataFrame([("f", "Type\r\n3\r\n1\r\n")], "path string, value string"))) == [("f", 0, 3), ("f", 1, 1)]
    with pytest.raises(Exception, match="no column Type"):
        runs.annotations(spark.createDataFrame([("f", "1\n2")], "path string, value string")).collect()
    text = '<P Direction="LeftDown"><L><Image Filename="D:\\s\\Z003-Z009\\t1.ims" MinX="1" MinY="2" MinZ="3"/><Other/></L></P>'
    assert rows(runs.stitch_projects(spark.createDataFrame([("p", text)], "path string, value string"), 10, 20)) == [("p", "t1.ims", 3, 9, 3.0, 8.0, 19.0)]
    with pytest.raises(Exception, match="lacks its name"):
        runs.stitch_projects(spark.createDataFrame([("p", text.replace(' MinX="1"', ""))], "path string, value string"), 10, 20).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 0, 1, 5, 1, 2, 3, 4, 5, 6), ("c", 0, 1, 6, 1, 2, 3, 4, 5, 6)], "brain string, tile_x int, tile_y int, label long, z0 int, y0 int, x0 int, z1 int, y1 int, x1 int")
    assert [writers.csv_beside(df, f"{tmp_path}/t") for _ in range(3)] == [f"{tmp_path}/t{s}" for s in ("", "_1", "_2")]
    writers.boxes(df, f"{tmp_path}/boxes")
    assert rows(spark.read.parquet(f"{tmp_path}/boxes").select("brain", "label", "x1")) == [("b", 5, 6), ("c", 6, 6)]
    writers.vertices_csv(spark.createDataFrame([(1, 2, 3)], "z int, y int, x int"), f"{tmp_path}/v")
    assert pd.concat(map(pd.read_csv, (tmp_path / "v").glob("*.csv"))).to_dict("records") == [{"X": 3, "Y": 2, "Z": 1}]
    writers.published(df, str(tmp_path), "stitch")
    at = writers.published(df.filter("brain = 'b'").withColumn("label", F.lit(7).cast("long")), str(tmp_path), "stitch")
    assert rows(spark.read.parquet(at).select("brain", "label")) == [("b", 7), ("c", 6)]
    writers.measures({"Volume": df, "Counts": df.select("label")}, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m/counts").columns == ["label"]
    for z in (10, 20):
        df.withColumn("c1", F.col("label") == 5).coalesce(1).write.parquet(f"{tmp_path}/stacks/instance_zmin{z}_.parquet")
    got = runs.instance_stacks(spark, f"{tmp_path}/stacks", 2.5, "c1")
    assert rows(got.select("label", "zmin", "z0", "z1")) == [(5, 25, 27.5, 35.0), (5, 50, 52.5, 60.0)]
    assert runs.instance_stacks(spark, f"{tmp_path}/stacks", 2.5, "c9").count() == 0
