"""A query for each operator, with the equivalent SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as G
from ..operators import identity, regions, series, spatial, statistics as S
from ..workers import on_workers
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ", ".join(views) + " " if views else "") + sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# maps

@query("SELECT brain, CAST(round_even(greatest(cz * 0.16, 0), 0) AS BIGINT) AS vz, CAST(round_even(greatest(cy * 0.03, 0), 0) AS BIGINT) AS vy, CAST(round_even(greatest(cx * 0.03, 0), 0) AS BIGINT) AS vx, count(*) AS n FROM boxes GROUP BY ALL", V.BOXES)
def density_map(spark, d):
    b = V.boxes(spark, d)
    return b.groupBy("brain", *(G.voxel_rounded(F.col(f"c{a}"), r).alias(f"v{a}") for a, r in (("z", 0.16), ("y", 0.03), ("x", 0.03)))).agg(F.count("*").alias("n"))


@query("SELECT brain, CAST(round_even(greatest(cz * 0.16, 0), 0) AS BIGINT) AS vz, CAST(round_even(greatest(cy * 0.03, 0), 0) AS BIGINT) AS vy, round(avg(volume), 6) AS mean_volume FROM boxes GROUP BY ALL", V.BOXES)
def avg_volume_map(spark, d):
    b = V.boxes(spark, d)
    return b.groupBy("brain", *(G.voxel_rounded(F.col(f"c{a}"), r).alias(f"v{a}") for a, r in (("z", 0.16), ("y", 0.03)))).agg(r6(F.avg("volume"), "mean_volume"))


@query("SELECT brain, CAST(floor(least(greatest(z0 * 0.16, 0), 31.1)) AS BIGINT) AS vz, count(*) AS n FROM boxes GROUP BY ALL", V.BOXES)
def density_truncated(spark, d):
    return V.boxes(spark, d).groupBy("brain", G.voxel_truncated(F.col("z0") * 0.16, 32).alias("vz")).agg(F.count("*").alias("n"))


@query("SELECT brain, cy // 256 AS ty, cx // 256 AS tx, count(*) AS n FROM boxes GROUP BY ALL", V.BOXES)
def local_density_256(spark, d):
    return V.boxes(spark, d).groupBy("brain", F.floor(F.col("cy") / 256).alias("ty"), F.floor(F.col("cx") / 256).alias("tx")).agg(F.count("*").alias("n"))


# instances from voxels

@query("SELECT label, count(*) AS volume FROM voxels WHERE label > 0 GROUP BY ALL", V.VOXELS)
def instance_volume(spark, d):
    return V.voxels(spark, d).filter("label > 0").groupBy("label").agg(F.count("*").alias("volume"))


@query("SELECT label, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM voxels GROUP BY ALL", V.VOXELS)
def instance_bbox(spark, d):
    return V.voxels(spark, d).groupBy("label").agg(*(f(a).alias(f"{a}{i}") for a in "zyx" for i, f in ((0, F.min), (1, F.max))))


@query("SELECT label, p.z AS z, p.y AS y, p.x AS x FROM (SELECT label, min(struct_pack(z := z, y := y, x := x)) AS p FROM voxels GROUP BY ALL)", V.VOXELS)
def instance_rep_point(spark, d):
    return V.voxels(spark, d).groupBy("label").agg(F.min(F.struct("z", "y", "x")).alias("p")).select("label", "p.z", "p.y", "p.x")


@query("SELECT z, label, n, CAST(sum(n) OVER (PARTITION BY z ORDER BY label) AS BIGINT) AS stop, CAST(sum(n) OVER (PARTITION BY z ORDER BY label) - n AS BIGINT) AS start FROM (SELECT z, label, count(*) AS n FROM voxels GROUP BY ALL)", V.VOXELS)
def csr_offsets(spark, d):
    per = V.voxels(spark, d).groupBy("z", "label").agg(F.count("*").alias("n"))
    return per.withColumn("stop", series.running(F.col("n"), ["z"], ["label"])).withColumn("start", F.col("stop") - F.col("n"))


@query("SELECT brain, label, volume FROM boxes WHERE volume > 0 AND volume <= 30 AND volume >= 10", V.BOXES)
def volume_filter(spark, d):
    return V.boxes(spark, d).filter("volume > 0 AND volume <= 30 AND volume >= 10").select("brain", "label", "volume")


@query("SELECT label, CAST(floor(z / 35) AS BIGINT) AS chunk, count(*) AS n FROM voxels GROUP BY ALL", V.VOXELS)
def slice_chunks(spark, d):
    return V.voxels(spark, d).groupBy("label", F.floor(F.col("z") / 35).alias("chunk")).agg(F.count("*").alias("n"))


@query("SELECT z, n, lag(n) OVER (ORDER BY z) AS previous, lead(n) OVER (ORDER BY z) AS following FROM (SELECT z, count(*) AS n FROM voxels GROUP BY ALL)", V.VOXELS)
def neighbour_slices(spark, d):
    w = Window.orderBy("z")
    return V.voxels(spark, d).groupBy("z").agg(F.count("*").alias("n")).select("z", "n", F.lag("n").over(w).alias("previous"), F.lead("n").over(w).alias("following"))


@query("SELECT chunk, n, CAST(coalesce(sum(n) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS label_base FROM (SELECT z // 10 AS chunk, count(DISTINCT label) AS n FROM voxels GROUP BY ALL)", V.VOXELS)
def label_offset_carry(spark, d):
    per = V.voxels(spark, d).groupBy(F.floor(F.col("z") / 10).alias("chunk")).agg(F.countDistinct("label").alias("n"))
    return per.withColumn("label_base", series.running(F.col("n"), [], ["chunk"]) - F.col("n"))


@query("SELECT label, count(*) FILTER (WHERE v > 30000) AS fg, count(*) AS n FROM voxels GROUP BY ALL", V.VOXELS)
def fg_voxels_per_instance(spark, d):
    return V.voxels(spark, d).groupBy("label").agg(F.count_if(F.col("v") > 30000).alias("fg"), F.count("*").alias("n"))


@query("SELECT brain, max(tile_x) + 1 AS ncol, max(tile_y) + 1 AS nrow, count(DISTINCT tile_x * 3 + tile_y) AS tiles FROM boxes GROUP BY ALL", V.BOXES)
def grid_shape_by_brain(spark, d):
    return V.boxes(spark, d).groupBy("brain").agg((F.max("tile_x") + 1).alias("ncol"), (F.max("tile_y") + 1).alias("nrow"), F.countDistinct(F.col("tile_x") * 3 + F.col("tile_y")).alias("tiles"))


# geometry

@query("SELECT label, round(CAST(z0 * 0.625 + trunc((label % 100) * 0.625) AS DOUBLE), 6) AS z, round(CAST(greatest(y0 + tile_x * 400 * 0.8, 0) AS DOUBLE), 6) AS y, round(CAST(greatest(x0 + tile_y * 400 * 0.8, 0) AS DOUBLE), 6) AS x FROM boxes", V.BOXES)
def zscale_translate(spark, d):
    clip = lambda c: F.greatest(c, F.lit(0.0))
    return V.boxes(spark, d).select("label", r6(G.rescaled(F.col("z0"), F.col("label") % 100, 0.625), "z"), r6(clip(F.col("y0") + F.col("tile_x") * 400 * 0.8), "y"), r6(clip(F.col("x0") + F.col("tile_y") * 400 * 0.8), "x"))


@query("SELECT label, (cz * 500 + cy) * 500 + cx AS linear, cz AS uz, cy AS uy, cx AS ux FROM boxes", V.BOXES)
def raveled_index(spark, d):
    b = V.boxes(spark, d).select("label", G.ravel([F.col("cz"), F.col("cy"), F.col("cx")], [200, 500, 500]).alias("linear"))
    return b.select("*", *(c.alias(n) for c, n in zip(G.unravel(F.col("linear"), [200, 500, 500]), ("uz", "uy", "ux"), strict=True)))


@query("SELECT label, cx + 1 AS a, 200 - (cz + 1) + 1 AS b, 500 - (cy + 1) + 1 AS c FROM boxes", V.BOXES)
def permute_points(spark, d):
    return V.boxes(spark, d).select("label", (F.col("cx") + 1).alias("a"), G.flipped(F.col("cz") + 1, 200).alias("b"), G.flipped(F.col("cy") + 1, 500).alias("c"))


@query("SELECT vec_id, round(s[1] / greatest(s[2], 0.001), 6) AS r12, round(s[1] / greatest(s[3], 0.001), 6) AS r13 FROM (SELECT vec_id, list_reverse_sort([sqrt(list_sum(list_transform(embedding[1:8], lambda v: CAST(v AS DOUBLE) * v))), sqrt(list_sum(list_transform(embedding[9:16], lambda v: CAST(v AS DOUBLE) * v))), sqrt(list_sum(list_transform(embedding[17:24], lambda v: CAST(v AS DOUBLE) * v)))]) AS s FROM embeddings)")
def axis_ratios(spark, d):
    norm = lambda a: F.sqrt(F.aggregate(F.slice("embedding", a, 8), F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    a, b = G.axis_ratios(F.array(norm(1), norm(9), norm(17)))
    return V.table(spark, d, "embeddings").select("vec_id", r6(a, "r12"), r6(b, "r13"))


@query("SELECT label, printf('UltraII[%02d x %02d]', tile_x, tile_y) AS tile, CAST(regexp_extract('zmin' || (label % 500) || '_c', 'zmin(\\d+)_', 1) AS BIGINT) AS zmin FROM boxes", V.BOXES)
def tile_name(spark, d):
    return V.boxes(spark, d).select("label", G.tile_name(F.col("tile_x"), F.col("tile_y")).alias("tile"), F.regexp_extract(F.concat(F.lit("zmin"), F.col("label") % 500, F.lit("_c")), r"zmin(\d+)_", 1).cast("long").alias("zmin"))


@query("SELECT label, CAST(regexp_extract(f, '_C(\\d+)_', 1) AS BIGINT) - min(CAST(regexp_extract(f, '_C(\\d+)_', 1) AS BIGINT)) OVER () + 1 AS channel, CAST(regexp_extract(f, 'Z(\\d+)', 1) AS BIGINT) - min(CAST(regexp_extract(f, 'Z(\\d+)', 1) AS BIGINT)) OVER () + 1 AS z FROM (SELECT label, 's_C' || (1 + label % 3) || '_xyz-Table Z' || printf('%04d', 10 + cz) || '.tif' AS f FROM boxes)", V.BOXES)
def path_table(spark, d):
    from ..sources.readers import path_table as parse

    names = V.boxes(spark, d).select("label", F.concat(F.lit("s_C"), F.lit(1) + F.col("label") % 3, F.lit("_xyz-Table Z"), F.format_string("%04d", F.lit(10) + F.col("cz")), F.lit(".tif")).alias("f"))
    return parse(names, "f", {"channel": r"_C(\d+)_", "z": r"Z(\d+)"}).select("label", "channel", "z")


# spatial joins and identity

def _tiles(spark, d):
    return V.boxes(spark, d).select("brain", "tile_x", "tile_y").distinct()


@query("SELECT a.brain, a.tile_x AS ax, a.tile_y AS ay, b.tile_x AS bx, b.tile_y AS by FROM t a JOIN t b ON a.brain = b.brain AND abs(a.tile_x - b.tile_x) <= 1 AND abs(a.tile_y - b.tile_y) <= 1 AND (a.tile_x < b.tile_x OR a.tile_x = b.tile_x AND a.tile_y < b.tile_y)", V.BOXES, "t AS (SELECT DISTINCT brain, tile_x, tile_y FROM boxes)")
def tile_neighbours(spark, d):
    return spatial.neighbour_tiles(_tiles(spark, d))


@query("SELECT label, brain FROM boxes WHERE (tile_x > 0 AND y0 < 250) OR (tile_x < 2 AND y1 > 250) OR x0 <= 0 OR x1 >= 500", V.BOXES)
def seam_candidates(spark, d):
    seam = identity.in_seam(F.col("y0"), F.col("y1"), F.lit(0), 500, 0.5, F.col("tile_x") == 0, F.col("tile_x") == 2)
    return V.boxes(spark, d).filter(seam | (F.col("x0") <= 0) | (F.col("x1") >= 500)).select("label", "brain")


_PAIRS = """pairs AS (SELECT a.brain, a.label AS a_label, b.label AS b_label, abs(a.cy - 250) + abs(a.cx - 250) AS a_far, abs(b.cy - 250) + abs(b.cx - 250) AS b_far,
    (least(a.z1, b.z1) - greatest(a.z0, b.z0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS shared, 8 * a.h * a.h * a.h AS av, 8 * b.h * b.h * b.h AS bv
    FROM boxes a JOIN boxes b ON a.brain = b.brain AND a.label < b.label AND (a.tile_x <> b.tile_x OR a.tile_y <> b.tile_y)
    AND least(a.z1, b.z1) > greatest(a.z0, b.z0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND least(a.x1, b.x1) > greatest(a.x0, b.x0)),
ious AS (SELECT *, shared / (av + bv - shared) AS iou FROM pairs)"""


def _pairs(spark, d):
    b = V.boxes(spark, d).withColumn("far", F.abs(F.col("cy") - 250) + F.abs(F.col("cx") - 250))
    keep = ["label", "tile_x", "tile_y", "far", *(f"{a}{i}" for a in "zyx" for i in (0, 1))]
    side = lambda p: b.select("brain", *(F.col(c).alias(p + c) for c in keep))
    other = (F.col("a_label") < F.col("b_label")) & ((F.col("a_tile_x") != F.col("b_tile_x")) | (F.col("a_tile_y") != F.col("b_tile_y")))
    return spatial.overlapping_boxes(side("a_"), side("b_"), ["brain"], 16.0, other)


@query("SELECT brain, a_label, b_label, round(iou, 6) AS iou FROM ious", V.BOXES, _PAIRS)
def box_iou_pairs(spark, d):
    return _pairs(spark, d).select("brain", "a_label", "b_label", r6(F.col("iou"), "iou"))


@query("SELECT brain, a_label, b_label FROM (SELECT *, row_number() OVER (PARTITION BY brain, a_label ORDER BY iou DESC, b_label) AS k FROM ious) WHERE k = 1", V.BOXES, _PAIRS)
def best_overlap(spark, d):
    return identity.best_match(_pairs(spark, d), ["brain", "a_label"], "iou", "b_label").select("brain", "a_label", "b_label")


@query("SELECT brain, b_label AS label, a_label AS source FROM (SELECT *, row_number() OVER (PARTITION BY brain, b_label ORDER BY iou DESC, a_label) AS k FROM ious) WHERE k = 1", V.BOXES, _PAIRS)
def best_source_per_target(spark, d):
    return identity.best_match(_pairs(spark, d), ["brain", "b_label"], "iou", "a_label").select("brain", F.col("b_label").alias("label"), F.col("a_label").alias("source"))


_LOSERS = "losers AS (SELECT DISTINCT brain, CASE WHEN a_far > b_far THEN a_label WHEN a_far < b_far THEN b_label ELSE least(a_label, b_label) END AS label FROM ious WHERE iou > 0.1)"


@query("SELECT b.brain, b.label, b.volume FROM boxes b ANTI JOIN losers l ON b.brain = l.brain AND b.label = l.label", V.BOXES, _PAIRS, _LOSERS)
def nms_dedup(spark, d):
    return identity.dropped(V.boxes(spark, d), identity.suppressed(_pairs(spark, d), 0.1), ["brain", "label"]).select("brain", "label", "volume")


@query("SELECT brain, label, volume FROM boxes WHERE label NOT IN (SELECT src FROM remap)", V.BOXES, V.REMAP)
def drop_duplicates_anti(spark, d):
    return identity.dropped(V.boxes(spark, d), V.remap(spark, d).select("brain", F.col("src").alias("label")), ["brain", "label"]).select("brain", "label", "volume")


@query("""SELECT b.brain, b.label, round(coalesce((b.cz + s.cz) / 2, b.cz), 6) AS cz, CAST(b.volume + coalesce(s.volume, 0) AS BIGINT) AS volume
    FROM boxes b LEFT JOIN remap r ON b.brain = r.brain AND b.label = r.dst LEFT JOIN boxes s ON s.brain = r.brain AND s.label = r.src
    WHERE NOT EXISTS (SELECT 1 FROM remap q WHERE q.brain = b.brain AND q.src = b.label)""", V.BOXES, V.REMAP)
def zmerge_single_hop(spark, d):
    m = identity.merged_once(V.boxes(spark, d), V.remap(spark, d), ["brain"], ["cz"], ["volume"])
    return m.select("brain", "label", r6(F.col("cz"), "cz"), "volume")


_KNN = """p AS (SELECT brain, label, cy, cx, tile_x FROM boxes), d AS (SELECT a.brain, a.label AS a_id, b.label AS b_id, (a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx) AS d2
    FROM p a JOIN p b ON a.brain = b.brain AND a.tile_x = 0 AND b.tile_x = 1)"""


@query("SELECT brain, a_id, b_id, CAST(d2 AS DOUBLE) AS d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY brain, a_id ORDER BY d2, b_id) AS rank FROM d) WHERE rank <= 2", V.BOXES, _KNN)
def knn2(spark, d):
    b = V.boxes(spark, d)
    side = lambda df, p: df.select("brain", F.col("label").alias(f"{p}_id"), F.col("cy").alias(f"{p}_y"), F.col("cx").alias(f"{p}_x"))
    n = spatial.nearest(side(b.filter("tile_x = 0"), "a"), side(b.filter("tile_x = 1"), "b"), ["brain"], 2, 5.0)
    return n.select("brain", "a_id", "b_id", F.col("d2").cast("double").alias("d2"), F.col("rank").cast("long").alias("rank"))


@query("SELECT a.brain, a.label FROM boxes a WHERE a.tile_x = 0 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.brain = a.brain AND b.tile_x = 1 AND (a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx) <= 100)", V.BOXES)
def distance_anti(spark, d):
    b = V.boxes(spark, d)
    side = lambda df, p: df.select("brain", F.col("label").alias(f"{p}_id"), F.col("cy").alias(f"{p}_y"), F.col("cx").alias(f"{p}_x"))
    return spatial.without_near(side(b.filter("tile_x = 0"), "a"), side(b.filter("tile_x = 1"), "b"), ["brain"], 10).select("brain", F.col("a_id").alias("label"))


# transforms

_FILL = "CASE WHEN abs(tx) <= 60 THEN tx END"


@query(f"SELECT tile, z, round(coalesce(last_value({_FILL} IGNORE NULLS) OVER (PARTITION BY tile ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({_FILL} IGNORE NULLS) OVER (PARTITION BY tile ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS tx FROM shifts", V.SHIFTS)
def shift_fill(spark, d):
    return V.shifts(spark, d).select("tile", "z", r6(series.good_fill(F.col("tx"), F.abs("tx") <= 60, ["tile"], "z"), "tx"))


@query(f"SELECT tile, z, round(coalesce(last_value({_FILL} IGNORE NULLS) OVER (PARTITION BY tile ORDER BY z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS tx FROM shifts", V.SHIFTS)
def prev_shift_desc(spark, d):
    return V.shifts(spark, d).select("tile", "z", r6(series.last_good_descending(F.col("tx"), F.abs("tx") <= 60, ["tile"], "z"), "tx"))


@query("SELECT b.label, round(b.cx + t.tx, 6) AS x FROM boxes b JOIN shifts t ON b.tile_x * 3 + b.tile_y = t.tile AND b.cz = t.z", V.BOXES, V.SHIFTS)
def apply_tform(spark, d):
    t = V.shifts(spark, d).select("tile", "z", "tx")
    return V.boxes(spark, d).withColumn("tile", F.col("tile_x") * 3 + F.col("tile_y")).withColumn("z", F.col("cz")).join(t, ["tile", "z"]).select("label", r6(F.col("cx") + F.col("tx"), "x"))


@query("SELECT b.label, round(b.cx + t.miny, 6) AS x FROM boxes b JOIN (SELECT z // 50 * 50 AS zmin, z // 50 * 50 + 50 AS zmax, tile, min(tx) AS miny FROM shifts GROUP BY ALL) t ON b.tile_x * 3 + b.tile_y = t.tile AND t.zmin <= b.cz AND b.cz < t.zmax", V.BOXES, V.SHIFTS)
def interval_tform(spark, d):
    block = F.floor(F.col("z") / 50) * 50
    blocks = V.shifts(spark, d).groupBy("tile", block.alias("zmin"), (block + 50).alias("zmax")).agg(F.min("tx").alias("miny"))
    points = V.boxes(spark, d).withColumn("tile", F.col("tile_x") * 3 + F.col("tile_y"))
    return spatial.interval_lookup(points, blocks, ["tile"], "cz").select("label", r6(F.col("cx") + F.col("miny"), "x"))


@query("SELECT brain, tile_x, tile_y, CAST(sum(n) OVER (PARTITION BY brain, tile_x ORDER BY tile_y) AS BIGINT) AS shift FROM (SELECT brain, tile_x, tile_y, count(*) AS n FROM boxes GROUP BY ALL)", V.BOXES)
def cumulative_tile_offset(spark, d):
    per = V.boxes(spark, d).groupBy("brain", "tile_x", "tile_y").agg(F.count("*").alias("n"))
    return per.select("brain", "tile_x", "tile_y", series.running(F.col("n"), ["brain", "tile_x"], ["tile_y"]).alias("shift"))


# regions

@query("SELECT label, rid FROM regioned", V.BOXES, V.REGIONED)
def annotate_points(spark, d):
    p = V.boxes(spark, d).select("label", *(F.floor(F.col(f"c{a}") / 50).alias(f"b{a}") for a in "zyx"))
    return regions.annotated(p, V.atlas(spark), ["bz", "by", "bx"]).select("label", "rid")


@query("SELECT brain, rid, CAST(sum(volume) AS BIGINT) AS total, round(sum(volume) / count(*), 6) AS density, round(avg(volume), 6) AS mean FROM regioned WHERE rid <> 0 GROUP BY ALL", V.BOXES, V.REGIONED)
def roi_stats(spark, d):
    return regions.roi_stats(V.regions(V.boxes(spark, d)), ["brain"], "volume").select("brain", "rid", "total", r6(F.col("density"), "density"), r6(F.col("mean"), "mean"))


@query("SELECT brain, " + ", ".join(f"count(*) FILTER (WHERE rid = {i}) AS roi{i}" for i in range(1, 6)) + " FROM regioned GROUP BY ALL", V.BOXES, V.REGIONED)
def roi_pivot(spark, d):
    wide = V.regions(V.boxes(spark, d)).groupBy("brain").pivot("rid", list(range(1, 6))).count().na.fill(0)
    return wide.select("brain", *(F.col(str(i)).alias(f"roi{i}") for i in range(1, 6)))


@query("SELECT o.id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM ontology o LEFT JOIN ontology c ON c.path LIKE o.path || '%' LEFT JOIN (SELECT 'n' || rid AS id, count(*) AS n FROM regioned GROUP BY ALL) v ON v.id = c.id GROUP BY ALL", V.BOXES, V.REGIONED, V.ONTOLOGY)
def subtree_rollup(spark, d):
    v = V.regions(V.boxes(spark, d)).groupBy(F.concat(F.lit("n"), F.col("rid")).alias("id")).agg(F.count("*").alias("n"))
    return regions.subtree_sums(v, V.ontology(spark, d), "n").select("id", "n")


@query("SELECT r.label, b.id AS bin FROM regioned r JOIN ontology o ON o.id = 'n' || r.rid LEFT JOIN ontology b ON b.id IN ('r0', 'r1', 'r2') AND o.path LIKE b.path || '%'", V.BOXES, V.REGIONED, V.ONTOLOGY)
def ancestor_bin(spark, d):
    rows = V.regions(V.boxes(spark, d)).select("label", F.concat(F.lit("n"), F.col("rid")).alias("id"))
    o = V.ontology(spark, d)
    return regions.binned(rows, o, o.filter("id IN ('r0', 'r1', 'r2')")).select("label", "bin")


@query("SELECT id FROM ontology o WHERE NOT EXISTS (SELECT 1 FROM ontology c WHERE c.id <> o.id AND c.path LIKE '%/' || o.id || '/%')", V.ONTOLOGY)
def deepest_structures(spark, d):
    return regions.deepest(V.ontology(spark, d)).select("id")


@query("SELECT rid, count(*) FILTER (WHERE volume % 3 = 0) AS c0, count(*) FILTER (WHERE volume % 3 = 1) AS c1, count(*) FILTER (WHERE volume % 3 = 2) AS c2 FROM regioned GROUP BY ALL", V.BOXES, V.REGIONED)
def counts_by_class(spark, d):
    p = V.regions(V.boxes(spark, d)).withColumn("class", F.col("volume") % 3).groupBy("rid").pivot("class", [0, 1, 2]).count().na.fill(0)
    return p.select("rid", *(F.col(str(i)).alias(f"c{i}") for i in range(3)))


@query("SELECT rid, round(CAST(count(*) AS DOUBLE) * 0.000015625, 9) AS mm3 FROM regioned GROUP BY ALL", V.BOXES, V.REGIONED)
def structure_volume(spark, d):
    return V.regions(V.boxes(spark, d)).groupBy("rid").agg(F.round(F.count("*") * 0.000015625, 9).alias("mm3"))


@query("SELECT brain, rid, round(count(*) / sum(volume), 6) AS density FROM regioned GROUP BY ALL", V.BOXES, V.REGIONED)
def density_ratio(spark, d):
    b = V.regions(V.boxes(spark, d))
    n, v = b.groupBy("brain", "rid").agg(F.count("*").alias("n")), b.groupBy("brain", "rid").agg(F.sum("volume").alias("v"))
    return n.join(v, ["brain", "rid"]).select("brain", "rid", r6(F.col("n") / F.col("v"), "density"))


# cohorts

@query("SELECT c_custkey, coalesce(n_name, 'none') AS nation, coalesce(CAST(n_regionkey AS BIGINT), -1) AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey")
def cohort_join_default(spark, d):
    n = V.table(spark, d, "nation").filter("n_nationkey % 4 <> 0")
    return V.table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("nation"), F.coalesce(F.col("n_regionkey").cast("long"), F.lit(-1)).alias("region"))


_FIRSTS = "firsts AS (SELECT * FROM (SELECT roi, pair, gene, value, row_number() OVER (PARTITION BY roi, pair, gene ORDER BY s_suppkey) AS k FROM (SELECT s_suppkey % 3 AS roi, pair, gene, value, s_suppkey FROM cohort)) WHERE k = 1)"


@query("SELECT a.roi, a.pair, round(b.value - a.value, 6) AS diff FROM firsts a JOIN firsts b ON a.roi = b.roi AND a.pair = b.pair AND a.gene = 0 AND b.gene = 1", V.COHORT, _FIRSTS)
def pair_match(spark, d):
    w = Window.partitionBy("roi", "pair", "gene").orderBy("s_suppkey")
    f = V.cohort(spark, d).withColumn("roi", F.col("s_suppkey") % 3).withColumn("k", F.row_number().over(w)).filter("k = 1")
    a, b = (f.filter(f"gene = {g}").select("roi", "pair", F.col("value").alias(f"v{g}")) for g in (0, 1))
    return a.join(b, ["roi", "pair"]).select("roi", "pair", r6(F.col("v1") - F.col("v0"), "diff"))


@query("SELECT s_suppkey, roi FROM (SELECT *, avg(value) OVER (PARTITION BY roi) AS m, stddev_pop(value) OVER (PARTITION BY roi) AS s FROM cohort) WHERE abs(value - m) < 1.5 * s", V.COHORT)
def zscore_outlier(spark, d):
    return S.within_sigma(V.cohort(spark, d), "value", ["roi"], 1.5, False).select("s_suppkey", "roi")


@query("SELECT s_suppkey, roi FROM (SELECT *, avg(value) OVER (PARTITION BY roi, gene) AS m, stddev_pop(value) OVER (PARTITION BY roi, gene) AS s FROM cohort) WHERE abs(value - m) <= s", V.COHORT)
def sigma_band(spark, d):
    return S.within_sigma(V.cohort(spark, d), "value", ["roi", "gene"], 1.0, True).select("s_suppkey", "roi")


_ACCT = "acct AS (SELECT CAST(n_regionkey AS BIGINT) AS roi, CAST(c_nationkey % 2 AS BIGINT) AS gene, c_acctbal AS value, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_MOMENTS = "m AS (SELECT roi, gene, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM acct GROUP BY ALL)"


def _acct(spark, d):
    n = V.table(spark, d, "nation")
    return V.table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long").alias("roi"), (F.col("c_nationkey") % 2).cast("long").alias("gene"), F.col("c_acctbal").alias("value"), "c_custkey")


@query("SELECT roi, gene, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM m", V.COHORT, _ACCT, _MOMENTS)
def group_moments(spark, d):
    return S.moments(_acct(spark, d), ["roi", "gene"], "value").select("roi", "gene", "n", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"))


def _two_groups(spark, d):
    m = S.moments(_acct(spark, d), ["roi", "gene"], "value")
    a, b = (m.filter(f"gene = {g}").select("roi", *(F.col(c).alias(p + c) for c in ("n", "mean", "sd"))) for g, p in ((0, "a_"), (1, "b_")))
    return a.join(b, "roi")


@query("SELECT a.roi, round((a.mean - b.mean) / sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n), 6) AS t, round(pow(a.sd * a.sd / a.n + b.sd * b.sd / b.n, 2) / (pow(a.sd * a.sd / a.n, 2) / (a.n - 1) + pow(b.sd * b.sd / b.n, 2) / (b.n - 1)), 6) AS df FROM m a JOIN m b ON a.roi = b.roi AND a.gene = 0 AND b.gene = 1", _ACCT, _MOMENTS)
def t_statistic(spark, d):
    t, df = S.welch()
    return _two_groups(spark, d).select("roi", r6(t, "t"), r6(df, "df"))


_POOLED = """pooled AS (SELECT a.roi, a.n + b.n - 2 AS df, (a.mean - b.mean) / sqrt(((a.n - 1) * a.sd * a.sd + (b.n - 1) * b.sd * b.sd) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t FROM m a JOIN m b ON a.roi = b.roi AND a.gene = 0 AND b.gene = 1),
    density AS (SELECT roi, df, t, i, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * pow(1 + pow(abs(t) * i / 2000.0, 2) / df, -(df + 1) / 2.0) AS f FROM pooled, range(2001) r(i))"""


@query("SELECT roi, round(any_value(t), 6) AS t, CAST(any_value(df) AS DOUBLE) AS df, round(1 - 2 * any_value(abs(t)) / 6000.0 * sum(f * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END), 6) AS p FROM density GROUP BY roi", _ACCT, _MOMENTS, _POOLED)
def t_pvalue(spark, d):
    """The SQL integrates the density by Simpson's rule."""
    on_workers(spark)
    t, df = S.pooled()
    return _two_groups(spark, d).select("roi", t.alias("t"), df.alias("df")).select("roi", r6(F.col("t"), "t"), "df", r6(S.t_pvalue("t", "df"), "p"))


_P = "p AS (SELECT s_suppkey AS id, roi, ((s_suppkey * 7919) % 1000 + 1) / 1001.0 AS p FROM cohort)"


@query("SELECT id, roi, round(least(min(raw) OVER (PARTITION BY roi ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS q FROM (SELECT *, count(*) OVER (PARTITION BY roi) * p / row_number() OVER (PARTITION BY roi ORDER BY p, id) AS raw FROM p)", V.COHORT, _P)
def bh_fdr(spark, d):
    p = V.cohort(spark, d).select(F.col("s_suppkey").alias("id"), "roi", (((F.col("s_suppkey") * 7919) % 1000 + 1) / 1001.0).alias("p"))
    return S.with_bh(p, "p", ["roi"], "id").select("id", "roi", r6(F.col("q"), "q"))


# classes and intensities

@query("SELECT label, CASE WHEN v > m + s / 3 THEN 1 ELSE 0 END + 2 * CASE WHEN w > mw + sw / 3 THEN 1 ELSE 0 END AS class, count(*) AS n FROM (SELECT *, avg(v) OVER () AS m, stddev_samp(v) OVER () AS s, avg(w) OVER () AS mw, stddev_samp(w) OVER () AS sw FROM voxels) GROUP BY ALL", V.VOXELS)
def quadrant_class(spark, d):
    v = V.voxels(spark, d)
    s = v.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.avg("w").alias("mw"), F.stddev_samp("w").alias("sw"))
    code = (F.col("v") > F.col("m") + F.col("s") / 3).cast("int") + 2 * (F.col("w") > F.col("mw") + F.col("sw") / 3).cast("int")
    return v.crossJoin(F.broadcast(s)).groupBy("label", code.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT rid, count(*) FILTER (WHERE volume > 20) AS n, count(*) AS total, round(100.0 * count(*) FILTER (WHERE volume > 20) / count(*), 6) AS percent FROM regioned GROUP BY ALL", V.BOXES, V.REGIONED)
def class_share(spark, d):
    n = F.count_if(F.col("volume") > 20)
    return V.regions(V.boxes(spark, d)).groupBy("rid").agg(n.alias("n"), F.count("*").alias("total"), r6(100.0 * n / F.count("*"), "percent"))


@query("SELECT brain, label FROM boxes, (SELECT 0.4 * avg(volume) + 0.25 * stddev_samp(volume) + 0.1 * median(volume) + 0.2 * any_value(mad) + 0.1 * any_value(q) AS t FROM boxes, (SELECT avg(abs(volume - m)) AS mad FROM boxes, (SELECT avg(volume) AS m FROM boxes)), (SELECT sum(volume * greatest(1 - abs(r - place), 0)) AS q FROM (SELECT volume, row_number() OVER (ORDER BY volume, label) AS r, least(greatest(count(*) OVER () * 0.9 + 0.5, 1), count(*) OVER ()) AS place FROM boxes))) WHERE volume > t", V.BOXES)
def threshold_expr(spark, d):
    from ..operators.classes import threshold_of

    b = V.boxes(spark, d)
    return b.crossJoin(F.broadcast(threshold_of(b, "0.4*mean + 0.25*std 0.1*median + 0.2*mad 0.1*prctile(90)", "volume"))).filter("volume > threshold").select("brain", "label")


@query("SELECT label, volume % 2 + 2 * (h - 2) AS class FROM boxes", V.BOXES)
def custom_class(spark, d):
    from ..operators.classes import formula

    return V.boxes(spark, d).select("label", (F.col("volume") % 2).alias("CT1"), (F.col("h") - 2).alias("CT2")).select("label", formula("CT1 + 2*CT2", ["CT1", "CT2"]).cast("long").alias("class"))


@query("SELECT y, v AS p FROM (SELECT y, v, row_number() OVER (PARTITION BY y ORDER BY v) AS r, count(*) OVER (PARTITION BY y) AS n FROM voxels) WHERE r = greatest(ceil(n * 0.9), 1)", V.VOXELS)
def percentile_nearest_rank(spark, d):
    return S.percentile_nearest_rank(V.voxels(spark, d), "v", ["y"], 0.9)


@query("SELECT y, round(quantile_cont(v, 0.9), 6) AS p FROM voxels GROUP BY ALL", V.VOXELS)
def percentile_linear(spark, d):
    return V.voxels(spark, d).groupBy("y").agg(r6(F.percentile("v", F.lit(0.9)), "p"))


@query("SELECT CAST(floor(v / 5000) AS BIGINT) AS bin, count(*) AS n FROM voxels GROUP BY ALL", V.VOXELS)
def intensity_histogram(spark, d):
    return V.voxels(spark, d).groupBy(F.floor(F.col("v") / 5000).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT z // 10 AS bz, y // 20 AS by, x // 32 AS bx, count(*) AS n FROM voxels WHERE z < 50 AND y < 100 GROUP BY ALL", V.VOXELS)
def hist3d(spark, d):
    return V.voxels(spark, d).filter("z >= 0 AND z < 50 AND y >= 0 AND y < 100").groupBy(F.floor(F.col("z") / 10).alias("bz"), F.floor(F.col("y") / 20).alias("by"), F.floor(F.col("x") / 32).alias("bx")).agg(F.count("*").alias("n"))


@query("SELECT CAST(sign(embedding[1]) AS INTEGER) AS sy, CAST(sign(embedding[2]) AS INTEGER) AS sx, count(*) AS n FROM embeddings GROUP BY ALL")
def sign_hist9(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.groupBy(F.signum(F.get("embedding", F.lit(0))).cast("int").alias("sy"), F.signum(F.get("embedding", F.lit(1))).cast("int").alias("sx")).agg(F.count("*").alias("n"))


@query("SELECT label FROM (SELECT label, stddev_samp(v) AS s FROM voxels GROUP BY ALL HAVING s IS NOT NULL) ORDER BY s DESC, label LIMIT 50", V.VOXELS)
def topk_std(spark, d):
    return V.voxels(spark, d).groupBy("label").agg(F.stddev_samp("v").alias("s")).filter("s IS NOT NULL").orderBy(F.desc("s"), "label").limit(50).select("label")


@query("SELECT y, round(avg(v), 6) AS top10 FROM (SELECT y, v, row_number() OVER (PARTITION BY y ORDER BY v DESC) AS r FROM voxels) WHERE r <= 10 GROUP BY ALL", V.VOXELS)
def top10_mean(spark, d):
    w = Window.partitionBy("y").orderBy(F.desc("v"))
    return V.voxels(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 10").groupBy("y").agg(r6(F.avg("v"), "top10"))


@query("SELECT label FROM boxes ORDER BY md5('7:' || label), label LIMIT 100", V.BOXES)
def sample_hash(spark, d):
    return S.hash_sample(V.boxes(spark, d), "label", 100, 7).select("label")


@query("SELECT x, round(sum(v * w) / sum(w), 6) AS mean FROM voxels GROUP BY ALL HAVING sum(w) > 0", V.VOXELS)
def weighted_overlap_mean(spark, d):
    return V.voxels(spark, d).groupBy("x").agg(F.sum("w").alias("sw"), (F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m")).filter("sw > 0").select("x", r6(F.col("m"), "mean"))


# series

@query("SELECT tile, z, CASE WHEN n IS NOT NULL THEN round(CASE WHEN n > 0 THEN ln(n) ELSE 0 END - CASE WHEN value > 0 THEN ln(value) ELSE 0 END, 6) END AS step FROM (SELECT tile, z, value, lead(value) OVER (PARTITION BY tile ORDER BY z) AS n FROM (SELECT tile, z, CASE WHEN z % 7 = 0 THEN 0 ELSE value END AS value FROM shifts))", V.SHIFTS)
def log_diff(spark, d):
    """Every seventh value is 0, whose logarithm counts as 0."""
    v = V.shifts(spark, d).withColumn("value", F.when(F.col("z") % 7 == 0, 0.0).otherwise(F.col("value")))
    return v.select("tile", "z", r6(series.log_step(F.col("value"), ["tile"], "z"), "step"))


@query("SELECT tile, z, round(a, 6) AS value FROM (SELECT tile, z, avg(value) OVER w AS a, count(*) OVER w AS n FROM shifts WINDOW w AS (PARTITION BY tile ORDER BY z ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE n = 7", V.SHIFTS)
def moving_avg7(spark, d):
    return series.moving_average(V.shifts(spark, d), "value", ["tile"], "z").select("tile", "z", r6(F.col("value"), "value"))


@query("""SELECT tile, kind, min(z) AS first, max(z) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY tile ORDER BY z) AS run FROM (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY tile ORDER BY z) THEN 0 ELSE 1 END AS new
    FROM (SELECT tile, z, CAST(sign(value - lag(value) OVER (PARTITION BY tile ORDER BY z)) AS INTEGER) AS kind FROM shifts) WHERE kind IS NOT NULL)) GROUP BY tile, run, kind""", V.SHIFTS)
def monotone_runs(spark, d):
    return series.monotone_runs(V.shifts(spark, d), "value", ["tile"], "z").drop("run")


@query("SELECT tile, z, l[CAST(floor((len(l) + 1) / 2) AS INTEGER)] AS m FROM (SELECT tile, z, list_sort(list(value) OVER (PARTITION BY tile ORDER BY z ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS l FROM shifts)", V.SHIFTS)
def median3_forward(spark, d):
    return V.shifts(spark, d).select("tile", "z", series.median3_forward("value", ["tile"], "z").alias("m"))


@query("SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / nullif(stddev_samp(value) OVER (PARTITION BY event_type), 0), 6) AS score FROM events")
def zscore_by_group(spark, d):
    return series.with_zscore(V.table(spark, d, "events"), "value", ["event_type"], "s").select("event_id", r6(F.col("s"), "score"))


# labels against labels

_IOU = """a AS (SELECT DISTINCT z, y, x, label % 50 AS ta FROM voxels), b AS (SELECT DISTINCT z, y, x, (label // 3) % 50 AS tb FROM voxels),
    c AS (SELECT ta, tb, count(*) AS n FROM a JOIN b USING (z, y, x) GROUP BY ALL)"""


def _contact(spark, d):
    from ..operators import metrics

    v = V.voxels(spark, d)
    return metrics.contact(v.select("z", "y", "x", (F.col("label") % 50).alias("ta")).distinct(), v.select("z", "y", "x", (F.floor(F.col("label") / 3) % 50).alias("tb")).distinct(), ["z", "y", "x"])


@query("SELECT ta, tb, n, round(n / (sum(n) OVER (PARTITION BY ta) + sum(n) OVER (PARTITION BY tb) - n), 6) AS iou FROM c", V.VOXELS, _IOU)
def label_contact_iou(spark, d):
    from ..operators import metrics

    return metrics.ious(_contact(spark, d)).select("ta", "tb", "n", r6(F.col("iou"), "iou"))


@query("SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp + fn, 0), 6) AS ap FROM (SELECT (SELECT count(DISTINCT ta) FROM c WHERE n >= 2) AS tp, (SELECT count(DISTINCT tb) FROM c) - (SELECT count(DISTINCT ta) FROM c WHERE n >= 2) AS fp, (SELECT count(DISTINCT ta) FROM c) - (SELECT count(DISTINCT ta) FROM c WHERE n >= 2) AS fn)", V.VOXELS, _IOU)
def detection_scores(spark, d):
    from ..operators import metrics

    c = _contact(spark, d)
    t = c.agg(F.countDistinct(F.when(F.col("n") >= 2, F.col("ta"))).alias("tp"), F.countDistinct("tb").alias("nb"), F.countDistinct("ta").alias("na"))
    return metrics.scores(t.select("tp", (F.col("nb") - F.col("tp")).alias("fp"), (F.col("na") - F.col("tp")).alias("fn")))


# sets and files

@query("SELECT DISTINCT z, y, x FROM voxels WHERE z < 10 UNION SELECT DISTINCT z, y, x FROM voxels WHERE y < 10", V.VOXELS)
def mask_union(spark, d):
    v = V.voxels(spark, d)
    return v.filter("z < 10").select("z", "y", "x").union(v.filter("y < 10").select("z", "y", "x")).distinct()


@query("SELECT label FROM boxes WHERE label % 3 = 0 UNION SELECT label FROM boxes WHERE label % 5 = 0", V.BOXES)
def union_distinct_ids(spark, d):
    b = V.boxes(spark, d)
    return b.filter("label % 3 = 0").select("label").union(b.filter("label % 5 = 0").select("label")).distinct()


@query("SELECT label FROM voxels WHERE z < 5 EXCEPT SELECT label FROM voxels WHERE y < 20", V.VOXELS)
def except_ids(spark, d):
    v = V.voxels(spark, d)
    return v.filter("z < 5").select("label").subtract(v.filter("y < 20").select("label"))


@query("SELECT label FROM voxels WHERE z < 5 INTERSECT SELECT label FROM voxels WHERE y < 20", V.VOXELS)
def intersect_ids(spark, d):
    v = V.voxels(spark, d)
    return v.filter("z < 5").select("label").intersect(v.filter("y < 20").select("label"))


@query("SELECT path, min(size) AS size FROM (SELECT 'f' || (o_orderkey % 5000) AS path, o_orderkey AS size FROM orders) GROUP BY ALL")
def file_catalogue_upsert(spark, d):
    from ..sources.writers import upserted

    o = V.table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey") % 5000).alias("path"), F.col("o_orderkey").alias("size"))
    first = o.groupBy("path").agg(F.min("size").alias("size"))
    return upserted(first, o, "path")


@query("SELECT b.brain, b.label, b.cz - min(b.cz) OVER () + 1 AS rebased FROM boxes b JOIN (SELECT cz FROM (SELECT cz, count(DISTINCT tile_x * 3 + tile_y) AS n FROM boxes GROUP BY ALL) WHERE n = (SELECT max(n) FROM (SELECT count(DISTINCT tile_x * 3 + tile_y) AS n FROM boxes GROUP BY cz))) q ON b.cz = q.cz", V.BOXES)
def complete_groups(spark, d):
    return series.complete_only(V.boxes(spark, d).withColumn("tile", F.col("tile_x") * 3 + F.col("tile_y")), "cz", "tile").select("brain", "label", "rebased")


@query("SELECT e.brain, e.tile FROM (SELECT DISTINCT a.brain, t.tile FROM (SELECT DISTINCT brain FROM boxes) a, (SELECT unnest(range(12)) AS tile) t) e ANTI JOIN (SELECT brain, tile_x * 3 + tile_y AS tile FROM boxes) h ON e.brain = h.brain AND e.tile = h.tile", V.BOXES)
def worklist_anti(spark, d):
    b = V.boxes(spark, d)
    expected = b.select("brain").distinct().withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    return expected.join(b.select("brain", (F.col("tile_x") * 3 + F.col("tile_y")).alias("tile")), ["brain", "tile"], "left_anti")


@query("SELECT label, 'y' AS dim, cy AS value FROM boxes UNION ALL SELECT label, 'x', cx FROM boxes", V.BOXES)
def unpivot_series(spark, d):
    b = V.boxes(spark, d).select("label", F.col("cy").alias("y"), F.col("cx").alias("x"))
    return b.unpivot("label", ["y", "x"], "dim", "value")


@query("SELECT brain, round(corr(CAST(cy AS DOUBLE), CAST(cx AS DOUBLE)), 6) AS r FROM boxes WHERE cy <> 0 AND cx <> 0 GROUP BY ALL", V.BOXES)
def masked_corr(spark, d):
    return V.boxes(spark, d).filter("cy <> 0 AND cx <> 0").groupBy("brain").agg(r6(F.corr(F.col("cy").cast("double"), F.col("cx").cast("double")), "r"))


@query("SELECT z, round(median(low), 6) AS low, round(max(high), 6) AS high, round(avg(mean), 6) AS mean FROM (SELECT z, x // 32 AS tile, quantile_cont(v, 0.05) AS low, quantile_cont(v, 0.95) AS high, avg(v) AS mean FROM voxels GROUP BY ALL) GROUP BY ALL", V.VOXELS)
def nested_sampling(spark, d):
    per = V.voxels(spark, d).groupBy("z", F.floor(F.col("x") / 32).alias("tile")).agg(F.percentile("v", F.lit(0.05)).alias("low"), F.percentile("v", F.lit(0.95)).alias("high"), F.avg("v").alias("mean"))
    return per.groupBy("z").agg(r6(F.median("low"), "low"), r6(F.max("high"), "high"), r6(F.avg("mean"), "mean"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def remap_json(spark, d):
    from ..sources.readers import json_map

    return json_map(V.table(spark, d, "events"), "props", "event_id").filter("key = 'k'").select("event_id", F.col("value").cast("long").alias("k"))


def fused_map(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain: merge across chunks, drop duplicates in overlaps, count by voxel."""
    merged = identity.merged_once(V.boxes(spark, d), V.remap(spark, d), ["brain"], ["cz", "cy", "cx"], ["volume"])
    kept = identity.dropped(merged, identity.suppressed(_pairs(spark, d), 0.1), ["brain", "label"])
    voxel = [G.voxel_rounded(F.col(f"c{a}"), r).alias(f"v{a}") for a, r in (("z", 0.16), ("y", 0.03), ("x", 0.03))]
    return kept.groupBy("brain", *voxel).agg(F.count("*").alias("n"), F.sum("volume").cast("long").alias("volume"))


query("""SELECT brain, CAST(round_even(greatest(cz * 0.16, 0), 0) AS BIGINT) AS vz, CAST(round_even(greatest(cy * 0.03, 0), 0) AS BIGINT) AS vy, CAST(round_even(greatest(cx * 0.03, 0), 0) AS BIGINT) AS vx, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM
    (SELECT b.brain, b.label, coalesce((b.cz + s.cz) / 2, b.cz) AS cz, coalesce((b.cy + s.cy) / 2, b.cy) AS cy, coalesce((b.cx + s.cx) / 2, b.cx) AS cx, b.volume + coalesce(s.volume, 0) AS volume
    FROM boxes b LEFT JOIN remap r ON b.brain = r.brain AND b.label = r.dst LEFT JOIN boxes s ON s.brain = r.brain AND s.label = r.src
    WHERE NOT EXISTS (SELECT 1 FROM remap q WHERE q.brain = b.brain AND q.src = b.label)) m ANTI JOIN losers l ON m.brain = l.brain AND m.label = l.label GROUP BY ALL""", V.BOXES, V.REMAP, _PAIRS, _LOSERS)(fused_map)
