"""Further queries, an operator of the survey each, with the equivalent SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as G
from ..operators import cells, identity, regions, series, statistics as S
from . import views as V
from .catalogue import _PAIRS, query, r6

# rows


@query("SELECT label, 'b' || brain || '_t' || tile_x || 'x' || tile_y AS id FROM boxes", V.BOXES)
def row_meta(spark, d):
    return V.boxes(spark, d).select("label", F.format_string("b%d_t%dx%d", "brain", "tile_x", "tile_y").alias("id"))


@query("SELECT label, (z0 + z1) / 2.0 AS z, (y0 + y1) / 2.0 AS y, (x0 + x1) / 2.0 AS x FROM boxes", V.BOXES)
def box_centre(spark, d):
    return V.boxes(spark, d).select("label", *(G.centre(F.col(f"{a}0"), F.col(f"{a}1")).alias(a) for a in "zyx"))


@query("SELECT label, x1 - x0 AS w, y1 - y0 AS h, z1 - z0 AS depth, CAST(floor((x0 + x1) / 2) AS BIGINT) AS x, cx - 50 AS low, cx + 51 AS high FROM boxes", V.BOXES)
def patch_window(spark, d):
    low, high = G.window(F.col("cx"), 101)
    return V.boxes(spark, d).select("label", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), (F.col("z1") - F.col("z0")).alias("depth"), F.floor(G.centre(F.col("x0"), F.col("x1"))).alias("x"), low.alias("low"), high.alias("high"))


@query("SELECT label, CAST(floor(cz + CAST(('0x' || substr(md5('3:' || label), 1, 8)) AS BIGINT) / 4294967296.0) AS BIGINT) AS z FROM (SELECT label, cz * 0.16 AS cz FROM boxes)", V.BOXES)
def voxel_hashed_z(spark, d):
    return V.boxes(spark, d).select("label", G.voxel_stochastic(F.col("cz") * 0.16, F.col("label"), 3).alias("z"))


@query("SELECT label, z, y, x, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS v FROM voxels", V.VOXELS)
def minmax_normalised(spark, d):
    v = V.voxels(spark, d)
    ends = v.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return v.crossJoin(F.broadcast(ends)).select("label", "z", "y", "x", r6((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")), "v"))


_RANKED = "ranked AS (SELECT z, v, row_number() OVER (PARTITION BY z ORDER BY v) AS r, count(*) OVER (PARTITION BY z) AS n FROM voxels)"
_ENDS = "ends AS (SELECT z, max(v) FILTER (WHERE r = greatest(ceil(n * 0.01), 1)) AS low, max(v) FILTER (WHERE r = greatest(ceil(n * 0.99), 1)) AS high FROM ranked GROUP BY z)"


@query("SELECT label, z, y, x, round(least(greatest((v - low) / greatest(high - low, 0.001), 0), 1), 6) AS v FROM voxels JOIN ends USING (z)", V.VOXELS, _RANKED, _ENDS)
def percentile_contrast(spark, d):
    return cells.contrast(V.voxels(spark, d), "v", ["z"], 0.01, 0.99).select("label", "z", "y", "x", r6(F.col("v"), "v"))


@query("SELECT label, round(CAST(volume AS DOUBLE) * 2.5 * 0.75 * 0.75, 6) AS um3, CAST(round_even(volume * 0.16, 0) AS BIGINT) AS cells, CAST(trunc(pow(volume * 0.75 / pi(), 1.0 / 3)) AS BIGINT) AS radius FROM boxes", V.BOXES)
def unit_scaling(spark, d):
    return V.boxes(spark, d).select("label", r6(F.col("volume") * 2.5 * 0.75 * 0.75, "um3"), F.rint(F.col("volume") * 0.16).cast("long").alias("cells"), G.equivalent_radius(F.col("volume")).alias("radius"))


@query("SELECT label, z, y, x, w > 0.05 AS fg, round(CASE WHEN w > 0.05 THEN v / 5 ELSE 0 END, 6) AS flow FROM voxels", V.VOXELS)
def foreground_flag(spark, d):
    fg = F.col("w") > 0.05
    return V.voxels(spark, d).select("label", "z", "y", "x", fg.alias("fg"), r6(F.when(fg, F.col("v") / 5).otherwise(0.0), "flow"))


@query("SELECT label, CAST(CASE WHEN volume > 20 THEN 1 ELSE 0 END + 2 * CASE WHEN h > 2 THEN 1 ELSE 0 END AS INTEGER) AS class FROM boxes", V.BOXES)
def class_code(spark, d):
    return V.boxes(spark, d).select("label", ((F.col("volume") > 20).cast("int") + 2 * (F.col("h") > 2).cast("int")).alias("class"))


@query("SELECT event_id, round(CASE WHEN abs(s) > 1 THEN sign(s) * (1 + log10(abs(s))) ELSE s END, 6) AS score FROM (SELECT event_id, (value - m) / nullif(sd, 0) AS s FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY ALL) USING (event_type))")
def outlier_compression(spark, d):
    e = series.with_zscore(V.table(spark, d, "events"), "value", ["event_type"], "s")
    return e.select("event_id", r6(cells.compressed(F.col("s"), 1.0), "score"))


@query("SELECT label, 'L' || brain || 'P' || (label % 5) AS brain_tag, 'pair' || (brain // 2) AS pair_tag, CAST(tile_x AS INTEGER) AS col, CAST(tile_y AS INTEGER) AS row FROM boxes", V.BOXES)
def path_tags(spark, d):
    path = F.format_string("/data/pair%d/x_L%dP%d_UltraII[%02d x %02d]", F.floor(F.col("brain") / 2), F.col("brain"), F.col("label") % 5, F.col("tile_x"), F.col("tile_y"))
    p, tile = F.element_at(F.split(path, "/"), -1), r"\[(\d+) x (\d+)\]"
    return V.boxes(spark, d).select("label", F.split_part(p, F.lit("_"), F.lit(2)).alias("brain_tag"), F.split_part(path, F.lit("/"), F.lit(3)).alias("pair_tag"), *(F.regexp_extract(p, tile, i).cast("int").alias(c) for i, c in ((1, "col"), (2, "row"))))


@query("SELECT label, tile_x AS col, tile_y AS row FROM boxes WHERE label % 3 <> 0", V.BOXES)
def printf_pattern(spark, d):
    name = F.when(F.col("label") % 3 == 0, F.lit("scan 1 x 2")).otherwise(G.tile_name(F.col("tile_x"), F.col("tile_y")))
    return cells.parsed(V.boxes(spark, d).withColumn("name", name), "name", "UltraII[%02d x %02d]", ["col", "row"]).select("label", "col", "row")


@query("SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE printf('%d.%02d', (n * 200 + d) // (2 * d) // 100, (n * 200 + d) // (2 * d) % 100) || u END AS text FROM (SELECT *, CASE WHEN n >= 1000000000 THEN 1000000000 WHEN n >= 1000000 THEN 1000000 ELSE 1000 END AS d, CASE WHEN n >= 1000000000 THEN 'B' WHEN n >= 1000000 THEN 'M' ELSE 'K' END AS u FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS n FROM orders))")
def humanised_number(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", G.humanised(F.col("o_orderkey") * F.col("o_orderkey")).alias("text"))


_RING = "concat_ws(', ', x0 || ' ' || y0 || ' ' || {z}, x1 || ' ' || y0 || ' ' || {z}, x1 || ' ' || y1 || ' ' || {z}, x0 || ' ' || y1 || ' ' || {z}, x0 || ' ' || y0 || ' ' || {z})"


@query(f"SELECT label, 'POLYGON Z ((' || {_RING.format(z='z0')} || '), (' || {_RING.format(z='z1')} || '))' AS wkt FROM boxes", V.BOXES)
def box_wkt(spark, d):
    return V.boxes(spark, d).select("label", G.box_wkt().alias("wkt"))


@query("SELECT b.label, round(b.cy + coalesce(t.tx, 0), 6) AS y FROM boxes b LEFT JOIN shifts t ON b.tile_x * 3 + b.tile_y = t.tile AND b.cz * 8 = t.z", V.BOXES, V.SHIFTS)
def global_coordinates(spark, d):
    b = V.boxes(spark, d).withColumn("tile", F.col("tile_x") * 3 + F.col("tile_y")).withColumn("z", F.col("cz") * 8)
    return b.join(V.shifts(spark, d).select("tile", "z", "tx"), ["tile", "z"], "left").select("label", r6(F.col("cy") + F.coalesce("tx", F.lit(0.0)), "y"))


@query("SELECT count(*) AS n, list_aggregate(list(code ORDER BY code), 'string_agg', ',') AS codes FROM (SELECT printf('%d%d%d', k % 2, k // 2 % 2, k // 4) AS code FROM range(8) t(k))")
def marker_combinations(spark, d):
    m = cells.combinations(spark, 3)
    return m.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


# filters


@query("SELECT label, v FROM (SELECT label, (volume - 8) * 30 AS v FROM boxes) WHERE v > 0 AND v <= 1000 AND v >= 30", V.BOXES)
def volume_bounds(spark, d):
    v = V.boxes(spark, d).select("label", ((F.col("volume") - 8) * 30).alias("v"))
    return v.filter("v > 0").filter("v <= 1000").filter("v >= 30")


@query("SELECT label, volume FROM boxes SEMI JOIN (SELECT label FROM voxels WHERE w > 0.08) l USING (label)", V.BOXES, V.VOXELS)
def layer_mask(spark, d):
    return V.boxes(spark, d).join(V.voxels(spark, d).filter("w > 0.08").select("label"), "label", "left_semi").select("label", "volume")


@query("SELECT label, (cy BETWEEN 200 AND 300) AND (cx BETWEEN 200 AND 300) AS closed, cy >= 200 AND cy < 300 AND cx >= 200 AND cx < 300 AS half_open FROM boxes WHERE cy >= 200 AND cy <= 300", V.BOXES)
def spatial_window(spark, d):
    y, x = F.col("cy"), F.col("cx")
    return V.boxes(spark, d).filter(y.between(200, 300)).select("label", (y.between(200, 300) & x.between(200, 300)).alias("closed"), ((y >= 200) & (y < 300) & (x >= 200) & (x < 300)).alias("half_open"))


@query("SELECT label, cz FROM boxes WHERE cz >= 40 AND (tile_x <> 1 OR cz < 90)", V.BOXES)
def z_range(spark, d):
    """Tile column 1 ends at 90; the others have -1, to the end."""
    most = F.when(F.col("tile_x") == 1, 90).otherwise(-1)
    return V.boxes(spark, d).filter(cells.in_range(F.col("cz"), F.lit(40), most)).select("label", "cz")


@query("SELECT label FROM regioned WHERE rid > 0", V.BOXES, V.REGIONED)
def inside_atlas(spark, d):
    p = V.boxes(spark, d).select("label", *(F.floor(F.col(f"c{a}") / 50).alias(f"b{a}") for a in "zyx"))
    return p.join(V.atlas(spark).filter("rid > 0"), ["bz", "by", "bx"], "left_semi").select("label")


@query("SELECT label, y0 >= 50 AND x0 >= 50 AND y1 <= 450 AND x1 <= 450 AS inside FROM boxes", V.BOXES)
def tile_margin(spark, d):
    return V.boxes(spark, d).select("label", ((F.least("y0", "x0") >= 50) & (F.greatest("y1", "x1") <= 450)).alias("inside"))


@query("SELECT z, label, n FROM (SELECT z, label, count(*) AS n, count(*) FILTER (WHERE w > 0.05) AS fg FROM voxels GROUP BY ALL) JOIN (SELECT z, count(*) AS total FROM voxels GROUP BY ALL) USING (z) WHERE n <= 0.01 * total AND fg > 0", V.VOXELS)
def usable_seeds(spark, d):
    v = V.voxels(spark, d)
    seeds = v.groupBy("z", "label").agg(F.count("*").alias("n"), F.count_if(F.col("w") > 0.05).alias("fg"))
    return seeds.join(v.groupBy("z").agg(F.count("*").alias("total")), "z").filter("n <= 0.01 * total AND fg > 0").select("z", "label", "n")


@query("SELECT z FROM (SELECT z, avg(m) AS mean FROM (SELECT z, y, max(v) AS m FROM voxels GROUP BY ALL) GROUP BY ALL) JOIN (SELECT z, min(m) AS low FROM (SELECT z, y < 50 AS a, x < 64 AS b, max(v) AS m FROM voxels GROUP BY ALL) GROUP BY ALL) USING (z) WHERE mean > 0.5 * low", V.VOXELS)
def foreground_tiles(spark, d):
    v = V.voxels(spark, d)
    rows = v.groupBy("z", "y").agg(F.max("v").alias("m")).groupBy("z").agg(F.avg("m").alias("mean"))
    corners = v.groupBy("z", (F.col("y") < 50).alias("a"), (F.col("x") < 64).alias("b")).agg(F.max("v").alias("m")).groupBy("z").agg(F.min("m").alias("low"))
    return rows.join(corners, "z").filter("mean > 0.5 * low").select("z")


@query("SELECT s_suppkey, round(CAST(value AS DOUBLE), 6) AS value FROM cohort WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0", V.COHORT)
def missing_sentinel(spark, d):
    text = F.when(F.col("s_suppkey") % 7 == 0, "-").when(F.col("s_suppkey") % 5 == 0, "0").otherwise(F.col("value").cast("string"))
    c = V.cohort(spark, d).select("s_suppkey", cells.known(text).alias("value"))
    return c.filter("value IS NOT NULL").select("s_suppkey", r6(F.col("value"), "value"))


@query("SELECT label, max(y) - min(y) AS h, max(x) - min(x) AS w FROM voxels GROUP BY ALL HAVING max(y) - min(y) >= 1 AND max(x) - min(x) >= 1", V.VOXELS)
def flat_boxes_dropped(spark, d):
    b = V.voxels(spark, d).groupBy("label").agg((F.max("y") - F.min("y")).alias("h"), (F.max("x") - F.min("x")).alias("w"))
    return b.filter("h >= 1 AND w >= 1")


@query("SELECT brain, count(*) = (max(tile_x) + 1) * (max(tile_y) + 1) AS whole FROM (SELECT DISTINCT brain, tile_x, tile_y FROM boxes WHERE brain <> 1 OR tile_x <> tile_y) GROUP BY ALL", V.BOXES)
def complete_grid(spark, d):
    t = V.boxes(spark, d).filter("brain <> 1 OR tile_x <> tile_y").select("brain", "tile_x", "tile_y").distinct()
    return t.groupBy("brain").agg((F.count("*") == (F.max("tile_x") + 1) * (F.max("tile_y") + 1)).alias("whole"))


_P4 = "p4 AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS p1, abs(CAST(embedding[2] AS DOUBLE)) AS p2, abs(CAST(embedding[3] AS DOUBLE)) AS p3, abs(CAST(embedding[4] AS DOUBLE)) AS p4 FROM embeddings)"


@query("SELECT vec_id, CASE WHEN p1 > 0.15 THEN 1 WHEN p2 > 0.15 THEN 2 WHEN p3 > 0.15 THEN 3 WHEN p2 - p3 > 0.05 THEN 2 WHEN p3 - p2 > 0.05 THEN 3 WHEN p1 > p4 THEN 1 ELSE 4 END AS class FROM p4", _P4)
def confidence_cascade(spark, d):
    p = [F.abs(F.get("embedding", F.lit(i)).cast("double")) for i in range(4)]
    return V.table(spark, d, "embeddings").select("vec_id", cells.cascade(*p, 0.15, 0.05).alias("class"))


@query("SELECT label, brain FROM boxes WHERE brain NOT IN (1, 3)", V.BOXES)
def excluded_brains(spark, d):
    gone = spark.createDataFrame([(1,), (3,)], "brain long")
    return V.boxes(spark, d).join(F.broadcast(gone), "brain", "left_anti").select("label", "brain")


_MEANS = "means AS (SELECT rid, avg(volume) FILTER (WHERE brain % 2 = 0) AS a, avg(volume) FILTER (WHERE brain % 2 = 1) AS b, count(*) AS n FROM regioned GROUP BY ALL)"


@query("SELECT rid, CASE WHEN greatest(a, b) <= 27.5 THEN 0 ELSE round(a, 6) END AS a, CASE WHEN greatest(a, b) <= 27.5 THEN 0 ELSE round(b, 6) END AS b, CASE WHEN greatest(a, b) <= 27.5 THEN 1 END AS p FROM means", V.BOXES, V.REGIONED, _MEANS)
def low_count_structures(spark, d):
    m = _sides(spark, d)
    low = F.greatest("a", "b") <= 27.5
    return m.select("rid", *(F.when(low, 0.0).otherwise(F.round(c, 6)).alias(c) for c in "ab"), F.when(low, 1).alias("p"))


def _sides(spark, d) -> DataFrame:
    b, even = V.regions(V.boxes(spark, d)), F.col("brain") % 2 == 0
    return b.groupBy("rid").agg(F.avg(F.when(even, F.col("volume"))).alias("a"), F.avg(F.when(~even, F.col("volume"))).alias("b"), F.count("*").alias("n"))


@query("SELECT rid, round((b - a) / a, 6) AS change, round(-log10(n / 100000.0), 6) AS score FROM means", V.BOXES, V.REGIONED, _MEANS)
def ratio_change(spark, d):
    return _sides(spark, d).select("rid", r6((F.col("b") - F.col("a")) / F.col("a"), "change"), r6(-F.log10(F.col("n") / 100000.0), "score"))


@query("SELECT label, CASE WHEN volume < 12 OR rid = 0 OR cy < 25 THEN 0 ELSE 1 + volume % 3 END AS class FROM regioned", V.BOXES, V.REGIONED)
def removal_mask(spark, d):
    gone = (F.col("volume") < 12) | (F.col("rid") == 0) | (F.col("cy") < 25)
    return V.regions(V.boxes(spark, d)).select("label", F.when(gone, 0).otherwise(1 + F.col("volume") % 3).alias("class"))


@query("SELECT label FROM boxes WHERE z0 >= 1 AND y0 >= 1 AND x0 >= 1 AND z1 <= 180 AND y1 <= 480 AND x1 <= 480", V.BOXES)
def inside_volume(spark, d):
    return V.boxes(spark, d).filter("least(z0, y0, x0) >= 1 AND z1 <= 180 AND greatest(y1, x1) <= 480").select("label")


@query("SELECT DISTINCT b.label FROM boxes b WHERE EXISTS (SELECT 1 FROM voxels m WHERE m.w > 0.07 AND m.z = b.cz // 4 AND m.x = b.cx // 4)", V.BOXES, V.VOXELS)
def mask_gated(spark, d):
    mask = V.voxels(spark, d).filter("w > 0.07").select("z", "x").distinct()
    p = V.boxes(spark, d).select("label", F.floor(F.col("cz") / 4).alias("z"), F.floor(F.col("cx") / 4).alias("x"))
    return p.join(mask, ["z", "x"], "left_semi").select("label")


@query("SELECT label, count(*) AS n FROM voxels GROUP BY ALL HAVING min(w) > 0", V.VOXELS)
def full_patches(spark, d):
    return V.voxels(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min("w").alias("low")).filter("low > 0").select("label", "n")


@query("SELECT brain, tile_x, tile_y, label FROM boxes JOIN (SELECT brain, cz FROM boxes GROUP BY ALL HAVING count(*) > 10) USING (brain, cz)", V.BOXES)
def crowded_slices(spark, d):
    b = V.boxes(spark, d)
    many = b.groupBy("brain", "cz").agg(F.count("*").alias("n")).filter("n > 10")
    return b.join(many, ["brain", "cz"], "left_semi").select("brain", "tile_x", "tile_y", "label")


# joins


@query("SELECT a.brain, a.tiles, t.tx FROM (SELECT brain, count(DISTINCT tile_x * 3 + tile_y) AS tiles FROM boxes GROUP BY ALL) a JOIN (SELECT tile AS brain, round(max(tx), 6) AS tx FROM shifts GROUP BY ALL) t USING (brain)", V.BOXES, V.SHIFTS)
def channel_join(spark, d):
    tars = V.boxes(spark, d).groupBy("brain").agg(F.countDistinct(F.col("tile_x") * 3 + F.col("tile_y")).alias("tiles"))
    return tars.join(V.shifts(spark, d).groupBy(F.col("tile").alias("brain")).agg(r6(F.max("tx"), "tx")), "brain").select("brain", "tiles", "tx")


@query("SELECT b.label, coalesce(n, 0) AS n, round(coalesce(m, 0), 6) AS mean FROM boxes b LEFT JOIN (SELECT label, count(*) AS n, avg(v) AS m FROM voxels WHERE w > 0.05 GROUP BY ALL) f ON b.label = f.label", V.BOXES, V.VOXELS)
def realigned_features(spark, d):
    f = V.voxels(spark, d).filter("w > 0.05").groupBy("label").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    return V.boxes(spark, d).select("label").join(f, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("m", F.lit(0.0)), "mean"))


@query("SELECT label, n_name AS name FROM regioned JOIN nation ON n_nationkey = rid WHERE n_nationkey % 3 = 0", V.BOXES, V.REGIONED)
def roi_names(spark, d):
    names = V.table(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("long").alias("rid"), F.col("n_name").alias("name"))
    return V.regions(V.boxes(spark, d)).join(names, "rid").select("label", "name")


@query("SELECT a.id AS ancestor, b.id FROM ontology a JOIN ontology b ON a.id <> b.id AND b.path LIKE '%/' || a.id || '/%'", V.ONTOLOGY)
def containment_pairs(spark, d):
    return regions.ancestors(V.ontology(spark, d)).filter("id <> ancestor").select("ancestor", "id")


@query("SELECT label, CASE volume % 6 WHEN 0 THEN 1 WHEN 1 THEN 23 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 60 + volume % 6 - 4 END AS layer FROM boxes WHERE volume % 7 IN (1, 3, 5)", V.BOXES)
def layer_bins(spark, d):
    layers = spark.createDataFrame([(0, 1), (1, 23), (2, 4), (3, 5), (4, 60), (5, 61)], "k long, layer long")
    classes = spark.createDataFrame([(1,), (3,), (5,)], "class long")
    b = V.boxes(spark, d).select("label", (F.col("volume") % 6).alias("k"), (F.col("volume") % 7).alias("class"))
    return b.join(F.broadcast(classes), "class", "left_semi").join(F.broadcast(layers), "k").select("label", "layer")


@query("SELECT cz AS z, tile_x AS channel, any_value(label) AS image FROM boxes WHERE brain = 0 GROUP BY ALL HAVING count(*) = 1", V.BOXES)
def unique_image(spark, d):
    b = V.boxes(spark, d).filter("brain = 0").select(F.col("cz").alias("z"), F.col("tile_x").alias("channel"), F.col("label").alias("image"))
    single = b.groupBy("z", "channel").agg(F.count("*").alias("n")).filter("n = 1").select("z", "channel")
    return cells.unique_join(single, b.join(single, ["z", "channel"], "left_semi"), ["z", "channel"])


@query("SELECT b.label, v.label AS other FROM boxes b JOIN voxels v ON v.z = b.cz // 4 AND v.y = b.cy // 5 AND v.x = b.cx // 4", V.BOXES, V.VOXELS)
def coordinate_lookup(spark, d):
    b = V.boxes(spark, d).select("label", F.floor(F.col("cz") / 4).alias("z"), F.floor(F.col("cy") / 5).alias("y"), F.floor(F.col("cx") / 4).alias("x"))
    return b.join(V.voxels(spark, d).select("z", "y", "x", F.col("label").alias("other")), ["z", "y", "x"]).select("label", "other")


_TILES = "tiles AS (SELECT DISTINCT brain, tile_x AS i, tile_y AS j FROM boxes WHERE brain <> 1 OR tile_x <> tile_y)"


@query("SELECT t.brain, t.i, t.j, coalesce(l.i, u.i) AS from_i, coalesce(l.j, u.j) AS from_j FROM tiles t LEFT JOIN tiles l ON l.brain = t.brain AND l.i = t.i AND l.j = t.j - 1 LEFT JOIN tiles u ON u.brain = t.brain AND u.i = t.i - 1 AND u.j = t.j WHERE l.i IS NOT NULL OR u.i IS NOT NULL", V.BOXES, _TILES)
def neighbour_strips(spark, d):
    t = V.boxes(spark, d).filter("brain <> 1 OR tile_x <> tile_y").select("brain", F.col("tile_x").alias("i"), F.col("tile_y").alias("j")).distinct()
    return cells.placed_neighbour(t)


@query("SELECT a.brain AS a, b.brain AS b FROM (SELECT DISTINCT brain FROM boxes) a, (SELECT DISTINCT brain FROM boxes) b WHERE a.brain <> b.brain", V.BOXES)
def brain_pairs(spark, d):
    brains = V.boxes(spark, d).agg(F.array_sort(F.collect_set("brain")).alias("all"))
    return brains.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).filter("a <> b")


@query("SELECT b.label, q.k AS compact, coalesce(r.dst, b.label) AS target FROM boxes b JOIN (SELECT label, row_number() OVER (PARTITION BY brain ORDER BY label) AS k FROM boxes) q ON b.label = q.label LEFT JOIN remap r ON r.src = b.label", V.BOXES, V.REMAP)
def renumbered(spark, d):
    b = V.boxes(spark, d).select("brain", "label")
    compact = b.select("label", F.row_number().over(Window.partitionBy("brain").orderBy("label")).cast("long").alias("compact"))
    maps = V.remap(spark, d).select(F.col("src").alias("label"), "dst")
    return b.join(compact, "label").join(maps, "label", "left").select("label", "compact", F.coalesce("dst", "label").alias("target"))


@query("SELECT s_suppkey, roi FROM cohort WHERE gene = 0 AND roi IN (SELECT roi FROM cohort WHERE pair = 1) UNION ALL SELECT s_suppkey, roi FROM cohort WHERE gene = 1 AND roi IN (SELECT roi FROM cohort WHERE pair = 1)", V.COHORT)
def group_merge(spark, d):
    c = V.cohort(spark, d)
    share = c.filter("pair = 1").select("roi").distinct()
    return c.filter("gene = 0").join(share, "roi", "left_semi").unionByName(c.filter("gene = 1").join(share, "roi", "left_semi")).select("s_suppkey", "roi")


@query("SELECT a_label, b_label FROM (SELECT *, row_number() OVER (PARTITION BY a_label ORDER BY s DESC, b_label) AS ra, row_number() OVER (PARTITION BY b_label ORDER BY s DESC, a_label) AS rb FROM (SELECT label % 50 AS a_label, x % 40 AS b_label, count(*) AS s FROM voxels GROUP BY ALL)) WHERE ra = 1 AND rb = 1", V.VOXELS)
def mutual_best(spark, d):
    s = V.voxels(spark, d).groupBy((F.col("label") % 50).alias("a_label"), (F.col("x") % 40).alias("b_label")).agg(F.count("*").alias("s"))
    return S.mutual_best(s, "a_label", "b_label", "s").select("a_label", "b_label")


@query()
def one_to_one(spark, d):
    s = V.voxels(spark, d).groupBy((F.col("label") % 50).alias("a_label"), (F.col("x") % 40).alias("b_label")).agg(F.count("*").alias("s"))
    return S.one_to_one(s, "a_label", "b_label", "s").select("a_label", "b_label", "s")


# aggregations


@query("SELECT label, string_agg(z || ':' || y || ':' || x, ' ' ORDER BY z, y, x) AS voxels FROM voxels GROUP BY ALL", V.VOXELS)
def voxels_by_label(spark, d):
    held = F.array_sort(F.collect_list(F.struct("z", "y", "x")))
    return V.voxels(spark, d).groupBy("label").agg(F.array_join(F.transform(held, lambda p: F.concat_ws(":", p["z"], p["y"], p["x"])), " ").alias("voxels"))


@query("SELECT label, round(avg(v) FILTER (WHERE w > 0.05), 6) AS mean FROM voxels GROUP BY ALL", V.VOXELS)
def masked_mean(spark, d):
    return V.voxels(spark, d).groupBy("label").agg(r6(F.avg(F.when(F.col("w") > 0.05, F.col("v"))), "mean"))


@query("SELECT rid % 5 AS region, round(avg(nullif(d, 0)), 6) AS density, CAST(sum(n) AS BIGINT) AS n FROM (SELECT rid, count(*) AS n, CASE WHEN rid % 4 = 0 THEN 0 ELSE avg(volume) END AS d FROM regioned GROUP BY rid) GROUP BY rid % 5", V.BOXES, V.REGIONED)
def region_collapse(spark, d):
    per = V.regions(V.boxes(spark, d)).groupBy("rid").agg(F.count("*").alias("n"), F.avg("volume").alias("d")).withColumn("d", F.when(F.col("rid") % 4 == 0, 0.0).otherwise(F.col("d")))
    return per.groupBy((F.col("rid") % 5).alias("region")).agg(r6(F.avg(F.nullif("d", F.lit(0.0))), "density"), F.sum("n").alias("n"))


@query("""SELECT vz, vy, round((mb - ma) / ma, 6) AS change, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 6) AS t, na + nb - 2 AS df FROM
    (SELECT cz // 20 AS vz, cy // 50 AS vy, count(*) FILTER (WHERE brain % 2 = 0) AS na, count(*) FILTER (WHERE brain % 2 = 1) AS nb, avg(volume) FILTER (WHERE brain % 2 = 0) AS ma, avg(volume) FILTER (WHERE brain % 2 = 1) AS mb,
    var_samp(volume) FILTER (WHERE brain % 2 = 0) AS va, var_samp(volume) FILTER (WHERE brain % 2 = 1) AS vb FROM boxes GROUP BY ALL) WHERE na > 1 AND nb > 1 AND va + vb > 0""", V.BOXES)
def voxel_group_stats(spark, d):
    b = V.boxes(spark, d).select(F.floor(F.col("cz") / 20).alias("vz"), F.floor(F.col("cy") / 50).alias("vy"), F.col("volume").alias("value"), (F.col("brain") % 2).alias("side"))
    return cells.group_difference(b, ["vz", "vy"]).select("vz", "vy", r6(F.col("change"), "change"), r6(F.col("t"), "t"), "df")


@query("SELECT z, round((sum(v) - coalesce(sum(v) FILTER (WHERE w > 0.05), 0)) / (count(*) - count(*) FILTER (WHERE w > 0.05)), 6) AS background FROM voxels GROUP BY ALL HAVING count(*) > count(*) FILTER (WHERE w > 0.05)", V.VOXELS)
def background_mean(spark, d):
    fg = F.col("w") > 0.05
    per = V.voxels(spark, d).groupBy("z").agg((F.sum("v") - F.coalesce(F.sum(F.when(fg, F.col("v"))), F.lit(0.0))).alias("s"), (F.count("*") - F.count_if(fg)).alias("n"))
    return per.filter("n > 0").select("z", r6(F.col("s") / F.col("n"), "background"))


@query("SELECT tile, round(list_reduce(list(value ORDER BY z), lambda a, b: (a + b) / 2), 6) AS folded, round(avg(value), 6) AS mean FROM shifts WHERE z <= 20 GROUP BY ALL", V.SHIFTS)
def pairwise_mean(spark, d):
    held = F.array_sort(F.collect_list(F.struct("z", "value")))
    fold = lambda a: F.aggregate(F.slice(a, 2, 1 << 30), F.element_at(a, 1)["value"], lambda s, p: (s + p["value"]) / 2)
    return V.shifts(spark, d).filter("z <= 20").groupBy("tile").agg(held.alias("h"), r6(F.avg("value"), "mean")).select("tile", r6(fold(F.col("h")), "folded"), "mean")


@query("SELECT volume, n, row_number() OVER (ORDER BY n DESC, volume) AS place FROM (SELECT volume, count(*) AS n FROM boxes GROUP BY volume)", V.BOXES)
def frequency_table(spark, d):
    n = V.boxes(spark, d).groupBy("volume").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "volume")).cast("long"))


@query("SELECT p.path, round(avg(v), 6) AS mean, round(sum(v), 2) AS total, round(max(v), 6) AS most FROM (SELECT k AS path, unnest(range(k, k + 8)) AS y FROM range(0, 100, 10) t(k)) p JOIN (SELECT y, sum(v) AS v FROM voxels GROUP BY ALL) q ON q.y = p.y GROUP BY ALL", V.VOXELS)
def path_projection(spark, d):
    paths = spark.range(0, 100, 10).select(F.col("id").alias("path"), F.explode(F.sequence(F.col("id"), F.col("id") + 7)).alias("y"))
    v = V.voxels(spark, d).groupBy("y").agg(F.sum("v").alias("v"))
    return paths.join(v, "y").groupBy("path").agg(r6(F.avg("v"), "mean"), F.round(F.sum("v"), 2).alias("total"), r6(F.max("v"), "most"))


@query("SELECT label, round(max(v), 6) AS most, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(avg(v) FILTER (WHERE x BETWEEN 32 AND 95), 6) AS middle, round(avg(v) FILTER (WHERE x BETWEEN 32 AND 95) / avg(v) FILTER (WHERE x < 32 OR x > 95), 6) AS contrast FROM voxels GROUP BY ALL", V.VOXELS)
def patch_features(spark, d):
    inside = F.col("x").between(32, 95)
    a, b = F.avg(F.when(inside, F.col("v"))), F.avg(F.when(~inside, F.col("v")))
    return V.voxels(spark, d).groupBy("label").agg(r6(F.max("v"), "most"), r6(F.avg("v"), "mean"), r6(F.stddev_samp("v"), "sd"), r6(a, "middle"), r6(a / b, "contrast"))


_IMAGE = "image AS (SELECT y, x, sum(v) AS v FROM voxels GROUP BY ALL)"


@query("SELECT b.label, round(avg(i.v), 6) AS mean, round(max(i.v), 6) AS most FROM boxes b JOIN image i ON i.y BETWEEN b.cy // 5 - 1 AND b.cy // 5 + 1 AND i.x BETWEEN b.cx // 4 - 1 AND b.cx // 4 + 1 GROUP BY ALL", V.BOXES, V.VOXELS, _IMAGE)
def neighbourhood3x3(spark, d):
    points = V.boxes(spark, d).select("label", F.floor(F.col("cy") / 5).alias("y"), F.floor(F.col("cx") / 4).alias("x"))
    image = V.voxels(spark, d).groupBy("y", "x").agg(F.sum("v").alias("v"))
    return cells.around(points, image, ["label"]).groupBy("label").agg(r6(F.avg("v"), "mean"), r6(F.max("v"), "most"))


@query("SELECT CASE WHEN label % 4 = 0 THEN 'fn' WHEN label % 4 = 1 THEN 'fp' ELSE 'tp' END AS outcome, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(DISTINCT label) AS n FROM voxels GROUP BY ALL", V.VOXELS)
def error_patterns(spark, d):
    k = F.col("label") % 4
    return V.voxels(spark, d).groupBy(F.when(k == 0, "fn").when(k == 1, "fp").otherwise("tp").alias("outcome")).agg(r6(F.avg("v"), "mean"), r6(F.stddev_samp("v"), "sd"), F.countDistinct("label").alias("n"))


@query("SELECT label, count(*) AS n, " + ", ".join(f"round(covar_pop({a}, {b}), 6) AS c{a}{b}" for a, b in ("zz", "yy", "xx", "zy", "zx", "yx")) + " FROM voxels GROUP BY ALL", V.VOXELS)
def instance_moments(spark, d):
    return cells.second_moments(V.voxels(spark, d), ["label"]).select("label", "n", *(F.round(f"c{a}{b}", 6).alias(f"c{a}{b}") for a, b in ("zz", "yy", "xx", "zy", "zx", "yx")))


@query()
def pca_extents(spark, d):
    return cells.principal_axes(cells.second_moments(V.voxels(spark, d), ["label"])).select("label", "n", "m1", "m2", "m3", "d1", "d2", "d3")


@query("SELECT DISTINCT brain, volume FROM boxes", V.BOXES)
def distinct_pairs(spark, d):
    return V.boxes(spark, d).select("brain", "volume").distinct()


@query("""SELECT brain, CASE WHEN avg(sy) <= avg(sx) THEN 'y' ELSE 'x' END AS axis FROM (SELECT brain, tile_x, stddev_pop(cy) AS sy, stddev_pop(cx) AS sx FROM boxes GROUP BY ALL) GROUP BY ALL""", V.BOXES)
def steadier_axis(spark, d):
    per = V.boxes(spark, d).groupBy("brain", "tile_x").agg(F.stddev_pop("cy").alias("sy"), F.stddev_pop("cx").alias("sx"))
    return per.groupBy("brain").agg(F.when(F.avg("sy") <= F.avg("sx"), "y").otherwise("x").alias("axis"))


@query("SELECT brain, tile_x, tile_y, round(avg(z0), 6) AS z FROM boxes GROUP BY ALL", V.BOXES)
def mean_block_z(spark, d):
    return V.boxes(spark, d).groupBy("brain", "tile_x", "tile_y").agg(r6(F.avg("z0"), "z"))


@query("SELECT tile, floor(count(*) * 0.015625 / 7) * 7 AS size, round(epoch(max(ts) - min(ts)) / 3600, 4) AS hours FROM (SELECT user_id % 9 AS tile, ts FROM events) GROUP BY ALL")
def size_and_time(spark, d):
    e = V.table(spark, d, "events").groupBy((F.col("user_id") % 9).alias("tile")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    seconds = F.expr("timestampdiff(MICROSECOND, a, z)") / 1e6
    return e.select("tile", (F.floor(F.col("n") * 0.015625 / 7) * 7).cast("double").alias("size"), F.round(seconds / 3600, 4).alias("hours"))


@query("SELECT rid, brain, round(avg(volume), 6) AS volume, round(avg(h), 6) AS h FROM regioned GROUP BY ALL", V.BOXES, V.REGIONED)
def region_brain_means(spark, d):
    return V.regions(V.boxes(spark, d)).groupBy("rid", "brain").agg(r6(F.avg("volume"), "volume"), r6(F.avg("h"), "h"))


@query("SELECT rid, brain, round(n / avg(n) OVER (PARTITION BY brain), 6) AS volume, round(area / avg(area) OVER (PARTITION BY brain), 6) AS area FROM (SELECT rid, brain, sum(volume) AS n, count(DISTINCT cy) AS area FROM regioned GROUP BY ALL)", V.BOXES, V.REGIONED)
def cortex_scaled(spark, d):
    per = V.regions(V.boxes(spark, d)).groupBy("rid", "brain").agg(F.sum("volume").alias("n"), F.countDistinct("cy").alias("area"))
    mean = per.groupBy("brain").agg(F.avg("n").alias("mn"), F.avg("area").alias("ma"))
    return per.join(F.broadcast(mean), "brain").select("rid", "brain", r6(F.col("n") / F.col("mn"), "volume"), r6(F.col("area") / F.col("ma"), "area"))


# windows and orders


@query("SELECT y, x, n FROM (SELECT *, max(row_max) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM (SELECT *, max(n) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS row_max FROM (SELECT y, x, count(*) AS n FROM voxels GROUP BY ALL))) WHERE n = m AND n > 8", V.VOXELS)
def local_maxima(spark, d):
    n = V.voxels(spark, d).groupBy("y", "x").agg(F.count("*").alias("n"))
    return series.local_maxima(n, "n", ["y", "x"]).filter("n > 8").select("y", "x", "n")


@query("SELECT brain, label, row_number() OVER (PARTITION BY brain ORDER BY volume DESC, label) AS place FROM boxes", V.BOXES)
def seeds_by_height(spark, d):
    return V.boxes(spark, d).select("brain", "label", F.row_number().over(Window.partitionBy("brain").orderBy(F.desc("volume"), "label")).cast("long").alias("place"))


_BACK = "CASE WHEN abs(tx) <= 60 THEN tx END"


@query(f"SELECT tile, z, round(coalesce(first_value({_BACK} IGNORE NULLS) OVER (PARTITION BY tile ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value({_BACK} IGNORE NULLS) OVER (PARTITION BY tile ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS tx FROM shifts", V.SHIFTS)
def back_forward_fill(spark, d):
    return V.shifts(spark, d).select("tile", "z", r6(series.back_fill(F.col("tx"), F.abs("tx") <= 60, ["tile"], "z"), "tx"))


@query("SELECT label, row_number() OVER (PARTITION BY brain ORDER BY label % 500, label) AS numeric_place, row_number() OVER (PARTITION BY brain ORDER BY 'zmin' || (label % 500) || '_c', label) AS text_place FROM boxes", V.BOXES)
def file_orders(spark, d):
    name = F.concat(F.lit("zmin"), F.col("label") % 500, F.lit("_c"))
    w, zmin = Window.partitionBy("brain"), F.regexp_extract(name, r"zmin(\d+)_", 1).cast("long")
    return V.boxes(spark, d).select("label", F.row_number().over(w.orderBy(zmin, "label")).cast("long").alias("numeric_place"), F.row_number().over(w.orderBy(name, "label")).cast("long").alias("text_place"))


@query("SELECT label, z, y, x FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY z DESC, y DESC, x DESC) AS k, count(*) OVER (PARTITION BY label) AS n FROM (SELECT label, z, y, x FROM voxels)) WHERE k = n", V.VOXELS)
def last_of_descending(spark, d):
    return V.voxels(spark, d).groupBy("label").agg(F.min(F.struct("z", "y", "x")).alias("p")).select("label", "p.z", "p.y", "p.x")


@query("SELECT tile_x, max_by('m_' || printf('%.2f', volume / 100.0) || '_' || label || '.pt', volume * 1000000 - label) AS file FROM boxes GROUP BY ALL", V.BOXES)
def best_file(spark, d):
    name = F.concat(F.format_string("m_%.2f_", F.col("volume") / 100.0), F.col("label"), F.lit(".pt"))
    score = F.struct(F.regexp_extract(name, r"_(\d+\.\d+)_", 1).cast("double"), -F.col("label"))
    return V.boxes(spark, d).groupBy("tile_x").agg(F.max_by(name, score).alias("file"))


@query("SELECT brain, i, row_number() OVER (PARTITION BY brain ORDER BY abs(i - mid), i) AS place FROM (SELECT brain, i, max(i) OVER (PARTITION BY brain) // 2 AS mid FROM (SELECT DISTINCT brain, tile_x * 3 + tile_y AS i FROM boxes))", V.BOXES)
def middle_out(spark, d):
    t = V.boxes(spark, d).select("brain", (F.col("tile_x") * 3 + F.col("tile_y")).alias("i")).distinct()
    mid = t.groupBy("brain").agg(F.floor(F.max("i") / 2).alias("mid"))
    return t.join(mid, "brain").select("brain", "i", F.row_number().over(Window.partitionBy("brain").orderBy(F.abs(F.col("i") - F.col("mid")), "i")).cast("long").alias("place"))


@query("SELECT brain, count(*) AS b_counts, CAST(sum(volume) AS BIGINT) AS a_volume FROM boxes GROUP BY ALL", V.BOXES)
def typed_columns(spark, d):
    wide = V.boxes(spark, d).groupBy("brain").agg(F.sum("volume").alias("a_volume"), F.count("*").alias("b_counts"))
    return wide.select("brain", *sorted((c for c in wide.columns if c != "brain"), key=lambda c: (c.split("_")[1], c)))


@query("SELECT label, 'chunk' AS kind FROM boxes WHERE tile_x = 0 UNION ALL SELECT label, 'tile' FROM boxes WHERE tile_y = 0 UNION ALL SELECT label, 'sample' FROM voxels WHERE z = 1", V.BOXES, V.VOXELS)
def union_all(spark, d):
    b = V.boxes(spark, d)
    parts = [b.filter("tile_x = 0").select("label", F.lit("chunk").alias("kind")), b.filter("tile_y = 0").select(F.lit("tile").alias("kind"), "label"), V.voxels(spark, d).filter("z = 1").select("label", F.lit("sample").alias("kind"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT brain, label, NULL AS x FROM boxes WHERE volume > 30 UNION ALL SELECT NULL, label, x FROM voxels WHERE z = 2", V.BOXES, V.VOXELS)
def channel_mix(spark, d):
    return V.boxes(spark, d).filter("volume > 30").select("brain", "label").unionByName(V.voxels(spark, d).filter("z = 2").select("label", "x"), allowMissingColumns=True)


@query("SELECT count(*) = count(DISTINCT label) AS once FROM boxes", V.BOXES)
def files_once(spark, d):
    return V.boxes(spark, d).agg((F.count("*") == F.countDistinct("label")).alias("once"))


# supporting modules


@query("SELECT tile, z, CASE WHEN abs(value - 100) <= 90 THEN CAST(floor(value) AS BIGINT) ELSE (SELECT k FROM (SELECT CAST(floor(value) AS BIGINT) AS k, count(*) AS n FROM shifts WHERE abs(value - 100) <= 90 GROUP BY ALL) ORDER BY n DESC, k LIMIT 1) END AS v FROM shifts", V.SHIFTS)
def mode_fill(spark, d):
    v = V.shifts(spark, d).withColumn("k", F.when(F.abs(F.col("value") - 100) <= 90, F.floor("value")))
    return cells.mode_filled(v, "k").select("tile", "z", F.col("k").alias("v"))


@query("SELECT DISTINCT z FROM voxels WHERE z IN (SELECT CAST(round(a + (b - a) * i / 6.0) AS BIGINT) FROM (SELECT min(z) AS a, max(z) AS b FROM voxels), range(7) t(i))", V.VOXELS)
def equally_spaced(spark, d):
    v = V.voxels(spark, d)
    return v.select("z").distinct().join(F.broadcast(cells.spaced(v, "z", 7)), "z", "left_semi")


@query("SELECT tile, k, round(exp(sum(ln(r)) OVER (PARTITION BY tile ORDER BY k)), 6) AS gain FROM (SELECT tile, k, coalesce(lag(p) OVER (PARTITION BY tile ORDER BY k) / p, 1) AS r FROM (SELECT tile, z // 50 AS k, quantile_cont(value, 0.9) AS p FROM shifts GROUP BY ALL))", V.SHIFTS)
def neighbour_gain(spark, d):
    p = V.shifts(spark, d).groupBy("tile", F.floor(F.col("z") / 50).alias("k")).agg(F.percentile("value", F.lit(0.9)).alias("p"))
    w = Window.partitionBy("tile").orderBy("k")
    return p.withColumn("r", F.coalesce(F.lag("p").over(w) / F.col("p"), F.lit(1.0))).select("tile", "k", r6(F.exp(F.sum(F.ln("r")).over(w)), "gain"))


@query("SELECT y, round(coalesce(median(v / (1000 + 10 * x)) FILTER (WHERE v > q), 1), 6) AS ratio FROM voxels JOIN (SELECT y, quantile_cont(v, 0.5) AS q FROM voxels GROUP BY ALL) USING (y) GROUP BY ALL", V.VOXELS)
def robust_ratio(spark, d):
    v = V.voxels(spark, d)
    q = v.groupBy("y").agg(F.percentile("v", F.lit(0.5)).alias("q"))
    ratio = F.median(F.when(F.col("v") > F.col("q"), F.col("v") / (1000 + 10 * F.col("x"))))
    return v.join(q, "y").groupBy("y").agg(r6(F.coalesce(ratio, F.lit(1.0)), "ratio"))


@query("SELECT s.id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'n' || rid AS id, count(*) AS n FROM regioned GROUP BY ALL) v JOIN ontology o ON o.id = v.id JOIN ontology s ON s.id IN ('r1', 'r3') AND o.path LIKE '%/' || s.id || '/%' GROUP BY ALL", V.BOXES, V.REGIONED, V.ONTOLOGY)
def subtree_counts(spark, d):
    v = V.regions(V.boxes(spark, d)).groupBy(F.concat(F.lit("n"), F.col("rid")).alias("id")).agg(F.count("*").alias("n"))
    return regions.subtree_sums(v, V.ontology(spark, d), "n").filter("id IN ('r1', 'r3')").select("id", "n")


@query("SELECT rid, 'even' AS side, 'volume' AS measure, round(a, 6) AS value FROM means UNION ALL SELECT rid, 'odd', 'volume', round(b, 6) FROM means", V.BOXES, V.REGIONED, _MEANS)
def wide_to_long(spark, d):
    wide = _sides(spark, d).select("rid", F.col("a").alias("even_volume"), F.col("b").alias("odd_volume"))
    long = wide.unpivot("rid", ["even_volume", "odd_volume"], "name", "value")
    return long.select("rid", F.split_part("name", F.lit("_"), F.lit(1)).alias("side"), F.split_part("name", F.lit("_"), F.lit(2)).alias("measure"), r6(F.col("value"), "value"))


@query("SELECT brain, bool_or(tile_x = 1) AS has_mask, bool_or(volume > 47) AS has_centroids, bool_and(h > 1) AS has_classes FROM boxes GROUP BY ALL", V.BOXES)
def sample_flags(spark, d):
    return V.boxes(spark, d).groupBy("brain").agg(F.bool_or(F.col("tile_x") == 1).alias("has_mask"), F.bool_or(F.col("volume") > 47).alias("has_centroids"), F.bool_and(F.col("h") > 1).alias("has_classes"))


@query("SELECT label, CASE label % 3 WHEN 0 THEN 'aligned' WHEN 1 THEN 'stitched' ELSE 'resampled' END AS place, CASE WHEN label % 3 < 2 THEN cz + 1 END AS z, 1 + label % 3 AS channel FROM boxes", V.BOXES)
def file_grammars(spark, d):
    z, c = F.format_string("%04d", F.col("cz") + 1), 1 + F.col("label") % 3
    name = F.when(F.col("label") % 3 == 0, F.concat(F.lit("s_"), z, F.lit("_C"), c, F.lit("_ms_01_02_aligned.tif"))).when(F.col("label") % 3 == 1, F.concat(F.lit("s_"), z, F.lit("_C"), c, F.lit("_ms_stitched.tif"))).otherwise(F.concat(F.lit("s_C"), c, F.lit("_ms_resampled.nii")))
    return cells.file_places(V.boxes(spark, d).select("label", name.alias("name")), "name").select("label", "place", "z", "channel")


@query("SELECT c.k AS chunk, count(*) AS n, count(*) FILTER (WHERE b.cz < c.k * 30 + 30 OR c.k = 6) AS own FROM (SELECT unnest(range(7)) AS k) c JOIN boxes b ON b.cz >= c.k * 30 AND b.cz < c.k * 30 + 40 GROUP BY ALL", V.BOXES)
def overlapping_chunks(spark, d):
    c = cells.in_chunks(V.boxes(spark, d), "cz", 40, 10, 7)
    return c.groupBy("chunk").agg(F.count("*").alias("n"), F.count_if(F.col("own")).alias("own"))


@query("SELECT label, cz // 50 AS block FROM boxes", V.BOXES)
def z_blocks(spark, d):
    return V.boxes(spark, d).select("label", F.floor(F.col("cz") / 50).alias("block"))


@query("SELECT label, CASE WHEN brain = 0 THEN 'val' WHEN brain = 1 THEN 'test' ELSE 'train' END AS part FROM boxes", V.BOXES)
def split_by_name(spark, d):
    lists = spark.createDataFrame([(0, "val"), (1, "test"), (2, "train"), (3, "train")], "brain long, part string")
    return cells.split_by_list(V.boxes(spark, d), lists, "brain").select("label", "part")


@query("SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, max(label) AS label FROM voxels GROUP BY ALL", V.VOXELS)
def label_rescale(spark, d):
    return cells.rescaled_labels(V.voxels(spark, d), 2)


@query("SELECT tile_x, label FROM (SELECT tile_x, label, row_number() OVER (ORDER BY volume DESC, label) AS k FROM boxes WHERE tile_x < 2) WHERE k <= 100", V.BOXES)
def merged_patches(spark, d):
    b = V.boxes(spark, d)
    both = b.filter("tile_x = 0").select("tile_x", "label", "volume").unionByName(b.filter("tile_x = 1").select("tile_x", "label", "volume"))
    top = both.orderBy(F.desc("volume"), "label").limit(100).select("label")
    return both.join(F.broadcast(top), "label", "left_semi").select("tile_x", "label")


@query("SELECT label FROM regioned JOIN nation ON n_nationkey = rid WHERE (n_name LIKE '%A' OR n_name LIKE '%7' OR n_name LIKE '%1') AND rid NOT IN (3, 5, 11)", V.BOXES, V.REGIONED)
def named_regions(spark, d):
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("rid"), "n_name")
    ids = n.filter((F.col("n_name").endswith("A") | F.col("n_name").endswith("7") | F.col("n_name").endswith("1")) & ~F.col("rid").isin(3, 5, 11))
    return V.regions(V.boxes(spark, d)).join(ids, "rid", "left_semi").select("label")


@query("SELECT b.brain, b.label, coalesce(r.dst, b.label) AS target, coalesce(t.volume % 3, b.volume % 3) AS class FROM boxes b LEFT JOIN remap r ON r.brain = b.brain AND r.src = b.label LEFT JOIN boxes t ON t.brain = b.brain AND t.label = r.dst", V.BOXES, V.REMAP)
def remapped_classes(spark, d):
    b = V.boxes(spark, d).select("brain", "label", (F.col("volume") % 3).alias("own"))
    r = V.remap(spark, d).select("brain", F.col("src").alias("label"), "dst")
    t = b.select("brain", F.col("label").alias("dst"), F.col("own").alias("of"))
    return b.join(r, ["brain", "label"], "left").join(t, ["brain", "dst"], "left").select("brain", "label", F.coalesce("dst", "label").alias("target"), F.coalesce("of", "own").alias("class"))


@query("SELECT DISTINCT n, CAST(floor(m) AS BIGINT) AS volume FROM (SELECT cz // 10 AS z, cy // 50 AS y, count(*) AS n, avg(volume) AS m FROM boxes GROUP BY ALL) WHERE n > 0 AND m BETWEEN 20 AND 30", V.BOXES)
def volume_tally(spark, d):
    per = V.boxes(spark, d).groupBy(F.floor(F.col("cz") / 10), F.floor(F.col("cy") / 50)).agg(F.count("*").alias("n"), F.avg("volume").alias("m"))
    return per.filter("n > 0 AND m BETWEEN 20 AND 30").select("n", F.floor("m").alias("volume")).distinct()


@query("SELECT y, v AS p FROM (SELECT y, v, row_number() OVER (PARTITION BY y ORDER BY v) AS r, count(*) OVER (PARTITION BY y) AS n FROM voxels) WHERE r = greatest(floor(n * 0.25), 1)", V.VOXELS)
def percentile_floor_rank(spark, d):
    return S.percentile_floor_rank(V.voxels(spark, d), "v", ["y"], 0.25)


@query("SELECT user_id % 9 AS batch, round(avg(CASE WHEN user_id % 5 = event_id % 5 THEN 1 ELSE 0 END), 6) AS accuracy FROM events GROUP BY ALL")
def label_accuracy(spark, d):
    right = (F.col("user_id") % 5 == F.col("event_id") % 5).cast("int")
    return V.table(spark, d, "events").groupBy((F.col("user_id") % 9).alias("batch")).agg(r6(F.avg(right), "accuracy"))


@query("SELECT a.cx AS path, round(avg(sqrt(pow(a.cz - b.cz, 2) + pow(a.cy - b.cy, 2))), 6) AS thickness FROM boxes a JOIN boxes b ON a.cx = b.cx AND a.brain = b.brain AND a.tile_x = 0 AND b.tile_x = 2 GROUP BY ALL", V.BOXES)
def surface_thickness(spark, d):
    b = V.boxes(spark, d)
    outer = b.filter("tile_x = 0").select("brain", F.col("cx").alias("path"), F.col("cz").alias("z"), F.col("cy").alias("y"))
    inner = b.filter("tile_x = 2").select("brain", F.col("cx").alias("path"), F.col("cz").alias("w"), F.col("cy").alias("v"))
    far = F.sqrt((F.col("z") - F.col("w")) ** 2 + (F.col("y") - F.col("v")) ** 2)
    return outer.join(inner, ["brain", "path"]).groupBy("path").agg(r6(F.avg(far), "thickness"))


@query("SELECT CASE WHEN rid < 5 THEN 1 WHEN rid < 12 THEN 2 ELSE 3 END AS part, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 0.000015625, 9) AS mm3 FROM regioned GROUP BY ALL", V.BOXES, V.REGIONED)
def grouped_structures(spark, d):
    groups = spark.range(25).select(F.col("id").alias("rid"), F.when(F.col("id") < 5, 1).when(F.col("id") < 12, 2).otherwise(3).alias("part"))
    return V.regions(V.boxes(spark, d)).join(F.broadcast(groups), "rid").groupBy("part").agg(F.count("*").alias("n"), F.round(F.count("*") * 0.000015625, 9).alias("mm3"))


# kernels in table form


@query("SELECT label, t.k AS tile, b.cx - t.k * 202 AS local FROM boxes b JOIN (SELECT unnest(range(3)) AS k) t ON b.cx >= t.k * 202 AND b.cx < t.k * 202 + 224", V.BOXES)
def tiled(spark, d):
    """Tiles of 224 that share a tenth with the next."""
    c = cells.in_chunks(V.boxes(spark, d), "cx", 224, 22, 3)
    return c.select("label", F.col("chunk").alias("tile"), (F.col("cx") - F.col("chunk") * 202).alias("local"))


@query("SELECT x, round(sum(v * k) / sum(k), 4) AS v FROM (SELECT x, v, CASE WHEN label % 2 = 0 THEN (x + 1) / 129.0 ELSE 1 - (x + 1) / 129.0 END AS k FROM voxels) GROUP BY ALL", V.VOXELS)
def blended_seam(spark, d):
    ramp = (F.col("x") + 1) / 129.0
    k = F.when(F.col("label") % 2 == 0, ramp).otherwise(1 - ramp)
    return V.voxels(spark, d).groupBy("x").agg(F.round(F.sum(F.col("v") * k) / F.sum(k), 4).alias("v"))


@query("SELECT z + 2 AS z, y - 3 AS y, x // 2 AS x, round(max(v), 6) AS v FROM voxels WHERE z + 2 < 50 AND y >= 3 GROUP BY ALL", V.VOXELS)
def shifted_volume(spark, d):
    v = V.voxels(spark, d).select((F.col("z") + 2).alias("z"), (F.col("y") - 3).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v")
    return v.filter("z < 50 AND y >= 0").groupBy("z", "y", "x").agg(r6(F.max("v"), "v"))


@query("SELECT class, n, round(sum(n) OVER () / (n * count(*) OVER ()), 6) AS weight FROM (SELECT volume % 4 AS class, count(*) AS n FROM boxes WHERE volume > 12 GROUP BY ALL)", V.BOXES)
def class_weights(spark, d):
    return cells.balanced(V.boxes(spark, d).filter("volume > 12").select((F.col("volume") % 4).alias("class")), "class").select("class", "n", r6(F.col("weight"), "weight"))


@query("SELECT label, n FROM (SELECT label, count(*) AS n, avg(w) AS e FROM voxels GROUP BY ALL) WHERE n >= 3 AND e <= 0.06", V.VOXELS)
def small_masks_removed(spark, d):
    return V.voxels(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.avg("w").alias("e")).filter("n >= 3 AND e <= 0.06").select("label", "n")


@query()
def kmeans_cosine(spark, d):
    return cells.clustered(V.table(spark, d, "embeddings"), "vec_id", "embedding", 3)


@query("SELECT label, CAST(regexp_extract('zmin' || (label % 500) || '_c', 'zmin(\\d+)_', 1) AS BIGINT) AS zmin FROM boxes", V.BOXES)
def filename_zmin(spark, d):
    return V.boxes(spark, d).select("label", F.regexp_extract(F.concat(F.lit("zmin"), F.col("label") % 500, F.lit("_c")), r"zmin(\d+)_", 1).cast("long").alias("zmin"))


@query("SELECT tile, round(min(tx), 6) AS low, round(max(tx), 6) AS high FROM shifts GROUP BY ALL", V.SHIFTS)
def tform_json(spark, d):
    """Shifts written as the JSON map of a tile and read back."""
    per = V.shifts(spark, d).groupBy("tile").agg(r6(F.min("tx"), "low"), r6(F.max("tx"), "high"))
    text = per.select(F.to_json(F.create_map(F.col("tile").cast("string"), F.array("low", "high"))).alias("value"))
    entry = text.select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("k", "t"))
    return entry.select(F.col("k").cast("long").alias("tile"), F.get("t", F.lit(0)).alias("low"), F.get("t", F.lit(1)).alias("high"))


# removal of duplicates as between two tiles: best target of each box, threshold by the distance to the tiles' centres

_SIDES = """far AS (SELECT brain, tile_x * 3 + tile_y AS tile, label, sqrt(pow((y0 + y1) / 2.0 - 250, 2) + pow((x0 + x1) / 2.0 - 250, 2)) AS far FROM boxes),
scaled AS (SELECT *, (far - min(far) OVER (PARTITION BY brain, tile)) / nullif(max(far) OVER (PARTITION BY brain, tile) - min(far) OVER (PARTITION BY brain, tile), 0) AS d FROM far),
turned AS (SELECT i.brain, t.tile AS t_tile, m.tile AS m_tile, t.label AS t_label, m.label AS m_label, t.far AS t_far, m.far AS m_far, coalesce(t.d, 0) * coalesce(m.d, 0) AS product, i.iou
    FROM ious i JOIN scaled a ON a.label = i.a_label JOIN scaled b ON b.label = i.b_label JOIN scaled t ON t.label = CASE WHEN a.tile < b.tile THEN a.label ELSE b.label END JOIN scaled m ON m.label = CASE WHEN a.tile < b.tile THEN b.label ELSE a.label END),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brain, t_tile, m_label ORDER BY iou DESC, t_label) AS k FROM turned) WHERE k = 1),
ends AS (SELECT brain, t_tile, m_tile, min(product) AS low, max(product) AS high FROM best GROUP BY ALL),
gone AS (SELECT DISTINCT brain, CASE WHEN t_far > m_far THEN t_label WHEN t_far < m_far THEN m_label ELSE least(t_label, m_label) END AS label FROM best JOIN ends USING (brain, t_tile, m_tile)
    WHERE iou >= 0.1 * least(greatest(coalesce((product - low) / nullif(high - low, 0), 0.05), 0.05), 0.5))"""


@query("SELECT b.brain, b.label, b.volume FROM boxes b ANTI JOIN gone g ON b.label = g.label", V.BOXES, _PAIRS, _SIDES)
def nms_adaptive(spark, d):
    b = V.boxes(spark, d).withColumn("tile", F.col("tile_x") * 3 + F.col("tile_y"))
    far = F.sqrt((G.centre(F.col("y0"), F.col("y1")) - 250) ** 2 + (G.centre(F.col("x0"), F.col("x1")) - 250) ** 2)
    gone = identity.suppressed_among(b.select("brain", "tile", "label", far.alias("far"), *(f"{a}{i}" for a in "zyx" for i in (0, 1))), 0.1)
    return identity.dropped(V.boxes(spark, d), gone, ["brain", "label"]).select("brain", "label", "volume")
