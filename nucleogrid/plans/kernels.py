"""Queries of files, runs, alignment and fitted classes, with the equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import alignment, learned, spatial
from ..sources import rasters, runs
from . import views as V
from .catalogue import query, r6

# files and runs

_GRID = (32, 16, 16)


@query("""SELECT 'fused:cell-count_' || brain || '.nii.gz' AS path, vz AS z, vy AS y, vx AS x, CAST(count(*) AS DOUBLE) AS v
    FROM (SELECT brain, cz * 32 // 200 AS vz, cy * 16 // 500 AS vy, cx * 16 // 500 AS vx FROM boxes) GROUP BY ALL""", V.BOXES)
def nifti_map(spark, d):
    """Maps as bytes of NIfTI files, decoded again."""
    at = lambda c, n, size: F.floor(F.col(c) * n / size).alias(c[1])
    n = V.boxes(spark, d).groupBy("brain", at("cz", 32, 200), at("cy", 16, 500), at("cx", 16, 500)).agg(F.count("*").alias("v"))
    held = rasters.nifti_files(n.withColumn("name", rasters.fused_name("cell count", F.col("brain"))), "name", _GRID)
    # a file's first two axes come back as y and x, its third as z
    back = rasters.nifti_voxels(held).filter("v <> 0")
    return back.select("path", F.col("y").alias("z"), F.col("x").alias("y"), F.col("z").alias("x"), "v")


@query("SELECT c_custkey AS run, round((((c_nationkey * 4000 + c_custkey % 3600 - c_custkey * 7 % 50000) % 86400 + 86400) % 86400) / 3600.0, 6) AS hours FROM customer WHERE c_custkey % 4 <> 0")
def run_log_hours(spark, d):
    c = V.table(spark, d, "customer")
    clock = lambda s: F.date_format(F.timestamp_seconds(F.lit(1706918400) + s), "EEE MMM d HH:mm:ss yyyy")
    first, last = F.col("c_custkey") * 7 % 50000, F.col("c_nationkey") * 4000 + F.col("c_custkey") % 3600
    text = F.concat_ws("\n", F.lit("run"), F.lit("begin"), clock(first), F.lit("..."), clock(last), F.lit("done"), F.when(F.col("c_custkey") % 4 == 0, "failed").otherwise("ok"), F.lit(""))
    logs = c.select(F.col("c_custkey").alias("path"), text.alias("value"))
    return runs.run_logs(logs).select(F.col("path").alias("run"), r6(F.col("hours"), "hours"))


@query("SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 4) - 1 AS row, CAST(l_partkey % 4 AS INTEGER) AS type FROM lineitem")
def annotation_rows(spark, d):
    held = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 4).alias("t")))).alias("l"))
    text = F.concat(F.lit("Type\n"), F.array_join(F.transform("l", lambda t: t["t"].cast("string")), "\n"), F.lit("\n"))
    return runs.annotations(held.select(F.col("l_orderkey").alias("path"), text.alias("value")))


@query("""SELECT n_regionkey AS path, n_name || '.ims' AS image, CAST(n_nationkey AS BIGINT) AS first, CAST(n_nationkey + 40 AS BIGINT) AS last, n_nationkey + 0.5 AS z,
    CASE WHEN n_regionkey % 2 = 1 THEN 900 - n_nationkey * 2.0 ELSE n_nationkey * 2.0 END AS y, CASE WHEN n_regionkey >= 2 THEN 700 - n_nationkey * 3.0 ELSE n_nationkey * 3.0 END AS x FROM nation""")
def stitch_projects(spark, d):
    n = V.table(spark, d, "nation")
    k = F.col("n_nationkey")
    image = F.format_string('<Image Filename="D:\\a\\Z%d-Z%d\\%s.ims" MinX="%s" MinY="%s" MinZ="%s"/>', k, k + 40, F.col("n_name"), k * 3.0, k * 2.0, k + 0.5)
    text = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list(image), "").alias("i"))
    way = F.concat(F.when(F.col("n_regionkey") >= 2, "Left").otherwise("Right"), F.when(F.col("n_regionkey") % 2 == 1, "Down").otherwise("Up"))
    value = F.concat(F.lit('<Project Direction="'), way, F.lit('"><Images>'), "i", F.lit("</Images></Project>"))
    return runs.stitch_projects(text.select(F.col("n_regionkey").alias("path"), value.alias("value")), 900, 700)


# alignment

_MATCHED = """near AS (SELECT a.brain, a.label AS a_id, b.label AS b_id, (a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx) AS d2
    FROM boxes a JOIN boxes b ON a.brain = b.brain AND a.tile_x = 0 AND b.tile_x = 1 AND (a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx) <= 225),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brain, a_id ORDER BY d2, b_id) AS k FROM near) WHERE k = 1)"""


@query("SELECT brain, a_id, b_id, CAST(d2 AS DOUBLE) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY brain, b_id ORDER BY d2, a_id) AS best FROM firsts) WHERE best = 1", V.BOXES, _MATCHED)
def stitch_match(spark, d):
    b = V.boxes(spark, d)
    side = lambda df, p: df.select("brain", F.col("label").alias(f"{p}_id"), F.col("cy").alias(f"{p}_y"), F.col("cx").alias(f"{p}_x"))
    return spatial.matched(side(b.filter("tile_x = 0"), "a"), side(b.filter("tile_x = 1"), "b"), ["brain"], 15).select("brain", "a_id", "b_id", F.col("d2").cast("double").alias("d2"))


@query()
def phase_shift(spark, d):
    """Images of slices against themselves, moved by z % 7 rows and z % 5 columns."""
    v = V.voxels(spark, d).groupBy("z", (F.col("y") % 64).alias("y"), (F.col("x") % 64).alias("x")).agg(F.sum("v").alias("v"))
    frame = v.select("z").distinct().select("z", F.lit(63).cast("long").alias("y"), F.lit(63).cast("long").alias("x"), F.lit(0.0).alias("v"))
    target = v.unionByName(frame).groupBy("z", "y", "x").agg(F.sum("v").alias("v")).withColumn("moving", F.lit(False))
    moving = target.withColumns({"y": F.pmod(F.col("y") - F.col("z") % 7, F.lit(64)), "x": F.pmod(F.col("x") - F.col("z") % 5, F.lit(64)), "moving": F.lit(True)})
    return alignment.phase_shift(target.unionByName(moving), ["z"])


@query()
def cpd_translation(spark, d):
    """Centres in slabs of 10 slices against themselves, moved by 2.5 and -1.25."""
    p = V.boxes(spark, d).select("brain", F.floor(F.col("cz") / 10).alias("slab"), F.col("cz").cast("double").alias("z"), F.col("cy").cast("double").alias("y"), F.col("cx").cast("double").alias("x"))
    moved = p.withColumns({"y": F.col("y") - 2.5, "x": F.col("x") + 1.25, "moving": F.lit(True)})
    return alignment.translation(p.withColumn("moving", F.lit(False)).unionByName(moved), ["brain", "slab"]).select("brain", "slab", F.round("ty", 3).alias("ty"), F.round("tx", 3).alias("tx"))


@query()
def tile_tree(spark, d):
    s = V.shifts(spark, d).withColumns({"i": F.floor(F.col("tile") / 3), "j": F.col("tile") % 3})
    edge = s.groupBy("i", "j", (F.col("z") % 2 == 0).alias("down")).agg(F.round(F.avg("tx"), 6).alias("z"), F.round(F.max("value"), 6).alias("quality"))
    inside = edge.filter((F.col("down") & (F.col("i") > 0)) | (~F.col("down") & (F.col("j") > 0)))
    return alignment.tree_offsets(inside.withColumn("brain", F.lit(0)), ["brain"]).select("brain", "i", "j", r6(F.col("z"), "z"))


@query()
def z_windows(spark, d):
    b = V.boxes(spark, d)
    of = lambda t: F.count(F.when(F.col("tile_x") == t, 1))
    return alignment.point_windows(b.groupBy("brain", F.col("cz").alias("z")).agg(of(0).alias("moving"), of(1).alias("target")), ["brain"])


_FLOW = """flow AS (SELECT z // 10 AS chunk, z % 10 AS z, y, x, (min(label) * 7 % 5 - 2) / 8.0 AS dz, (min(label) * 3 % 7 - 3) / 8.0 AS dy, (min(label) % 9 - 4) / 8.0 AS dx FROM voxels GROUP BY ALL),
walk AS (SELECT chunk, z, y, x, CAST(z AS DOUBLE) AS pz, CAST(y AS DOUBLE) AS py, CAST(x AS DOUBLE) AS px, 0 AS step FROM flow
    UNION ALL SELECT w.chunk, w.z, w.y, w.x, least(greatest(w.pz + f.dz, 0), 9), least(greatest(w.py + f.dy, 0), 127), least(greatest(w.px + f.dx, 0), 127), step + 1
    FROM walk w JOIN flow f ON f.chunk = w.chunk AND f.z = floor(w.pz) AND f.y = floor(w.py) AND f.x = floor(w.px) WHERE step < 139 AND (step > 0 OR abs(f.dz) > 0.001))"""


@query("SELECT chunk, z, y, x, max_by(pz, step) AS pz, max_by(py, step) AS py, max_by(px, step) AS px FROM walk GROUP BY ALL", "RECURSIVE " + V.VOXELS, _FLOW)
def flow_followed(spark, d):
    v = V.voxels(spark, d).groupBy(F.floor(F.col("z") / 10).alias("chunk"), (F.col("z") % 10).alias("z"), "y", "x").agg(F.min("label").alias("k"))
    part = lambda times, n, less: (F.col("k") * times % n - less) / 8.0
    flow = v.select("chunk", "z", "y", "x", part(7, 5, 2).alias("dz"), part(3, 7, 3).alias("dy"), part(1, 9, 4).alias("dx"))
    return alignment.followed(flow, ["chunk"], (10, 128, 128))


@query()
def low_pass(spark, d):
    v = V.voxels(spark, d).groupBy((F.col("z") % 5).alias("image"), (F.col("y") % 64).alias("y"), (F.col("x") % 64).alias("x")).agg(F.sum("v").alias("v"))
    return alignment.low_pass(v, ["image"]).select("image", "y", "x", F.round("v", 4).alias("v"))


# fitted classes


@query()
def gmm_posterior(spark, d):
    p = learned.mixture(V.table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "value", 2, steps=10)
    sure = learned.positive(F.col("p"), 0.5, F.col("event_id") % 3 == 0)
    return p.select("event_id", "event_type", F.round(F.element_at("p", -1), 4).alias("p"), sure.alias("positive"))


@query()
def svm_crossvalidated(spark, d):
    e = V.table(spark, d, "embeddings")
    return learned.confusion(learned.one_vs_all(e, "vec_id", "embedding", "label", 2, steps=5)).select("label", "predicted", "n", r6(F.col("share"), "share"))
