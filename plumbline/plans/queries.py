"""One query for each operator, over the demo scene and the plain tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import colours, names
from plumbline.functions import geometry as g
from plumbline.operators import catalog, components, detect, neighbors, orient, photo, planes, pose, quantiles, register
from plumbline.operators import points as pts
from plumbline.operators import quality as q
from plumbline.operators.storage import stored
from plumbline.plans import scene
from plumbline.sources import scans
from plumbline.streaming import picks

P = ("x", "y", "z")
R = g.rounded
TURN = math.radians(10)
MOVE = [[math.cos(TURN), -math.sin(TURN), 0.0, 0.5], [math.sin(TURN), math.cos(TURN), 0.0, -0.25], [0.0, 0.0, 1.0, 0.1]]
#: The demo scan is sparse at small scales: windows of the demo need fewer points than a real scan's.
LEAST = q.LEAST


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[R(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def rgb(cs) -> list:
    return [c.alias(n) for c, n in zip(cs, ("show_r", "show_g", "show_b"), strict=True)]


QUERIES: dict = {}


#: Coordinates made from prices may end in halves of the seventh digit, means in longer fractions.
DIGITS = dict.fromkeys(("to_zup", "to_yup", "apply_transform", "merge_clouds", "snap_to_plane", "project_points"), 7) | {"voxel_downsample": 9, "plane_fit": 8, "refit_filter": 8}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: longs(round_all(f(spark, sf_dir), DIGITS.get(f.__name__, 6)))
    return f


@query
def to_zup(spark, d):
    x, y, z = g.to_zup(*P)
    return scene.points(spark, d).select("point_id", x.alias("x"), y.alias("y"), z.alias("z"))


@query
def to_yup(spark, d):
    x, y, z = g.to_yup(*P)
    return scene.points(spark, d).select("point_id", x.alias("x"), y.alias("y"), z.alias("z"))


@query
def signed_distance(spark, d):
    p = planes.with_plane(scene.points(spark, d), scene.facades(spark), "facade_id")
    return p.select("point_id", g.signed_distance(P, planes.PLANE).alias("signed"), g.distance(P, planes.PLANE).alias("distance"))


@query
def plane_fit(spark, d):
    return planes.fit(scene.points(spark, d), "facade_id", "l_linenumber")


@query
def classify_planes(spark, d):
    f = planes.fit(scene.points(spark, d), "facade_id", "l_linenumber")
    lean = g.verticality("nc")
    return f.select("facade_id", "l_linenumber", g.plane_type("nc").alias("type"), lean.alias("verticality"), g.horizontality("nc").alias("horizontality"), g.vertical_deviation(lean).alias("deviation"))


@query
def plane_axes_uv(spark, d):
    p = scene.points(spark, d)
    return planes.with_uv(p, planes.fit(p, "facade_id"), "facade_id").select("point_id", "u", "v")


@query
def bbox(spark, d):
    return pts.bounding_box(scene.points(spark, d), "facade_id")


@query
def voxel_downsample(spark, d):
    return pts.voxel_downsample(scene.points(spark, d), 0.5, "facade_id")


@query
def facade_stats(spark, d):
    p = scene.points(spark, d)
    return planes.records(p, planes.fit(p, "facade_id"), "facade_id")


@query
def normals_hybrid_knn(spark, d):
    p = scene.points(spark, d).select("facade_id", "point_id", *P)
    return neighbors.normals(p, 0.35, 20, "facade_id").where("normal_points >= 10").select("point_id", "normal_points", *[F.round(c, 3).alias(c) for c in ("nx", "ny", "nz")])


@query
def oriented_normals(spark, d):
    """Each surface's normals, fitted anew and turned so that neighbours agree."""
    p = scene.points(spark, d).select("facade_id", "point_id", *P)
    turned = orient.consistent(neighbors.normals(p, 0.35, 20, "facade_id").drop("normal_points"), 8, 0.35, "facade_id")
    return turned.select("point_id", *[F.round(c, 3).alias(c) for c in ("nx", "ny", "nz")])


@query
def radius_outlier(spark, d):
    p = scene.points(spark, d).select("facade_id", "point_id", *P)
    return neighbors.radius_outliers(p, 0.2, 2, "facade_id").select("point_id")


@query
def statistical_outlier(spark, d):
    """Each supplier's points are a cloud."""
    p = scene.points(spark, d).select("l_suppkey", "point_id", *P)
    return neighbors.statistical_outliers(p, 8, 1.5, 1.0, "l_suppkey").select("point_id")


def _two_scans(spark, d):
    p = scene.points(spark, d).select("facade_id", "point_id", "l_linenumber", *P)
    return p.where("l_linenumber % 2 = 1"), p.where("l_linenumber % 2 = 0")


@query
def registration_error(spark, d):
    return neighbors.registration_error(*_two_scans(spark, d), 0.2, "facade_id")


@query
def ransac_seed(spark, d):
    p = scene.points(spark, d)
    drawn = planes.hypotheses(p, 64)
    best, inliers = planes.ransac(p, drawn, 0.05)
    return spark.createDataFrame([(best, inliers, *[x + 0.0 for x in drawn[best]])], "trial int, inliers long, na double, nb double, nc double, nd double")


@query
def candidate_filter(spark, d):
    p = planes.with_plane(scene.points(spark, d), scene.facades(spark), "facade_id")
    return p.where(planes.candidates(p, planes.PLANE, 0.004, 5.0)).select("point_id")


@query
def refit_filter(spark, d):
    return planes.refit(scene.points(spark, d), 0.002, "facade_id", "l_linenumber")


@query
def grid_components(spark, d):
    """Components of metre cells over the whole of every surface."""
    p = scene.points(spark, d)
    flat = stored(planes.with_uv(p, scene.facades(spark), "facade_id").select("facade_id", "point_id", R("u").alias("u"), R("v").alias("v")))
    found = components.grid_components(flat, 1.0, 3, "facade_id")
    return found.groupBy("facade_id", "component").agg(F.max("cells").alias("cells"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"))


@query
def dbscan_clusters(spark, d):
    """Each point's cluster; every surface is clustered by itself."""
    p = scene.points(spark, d).select("facade_id", "point_id", *P)
    return components.density_clusters(p, 0.3, 4, "facade_id")


@query
def dbscan_core_points(spark, d):
    p = scene.points(spark, d).select("facade_id", "point_id", *P)
    return neighbors.neighbour_counts(p, 0.2, "facade_id").where("neighbours + 1 >= 4").select("point_id", "neighbours")


DETECT = detect.Detection(voxel=0.05, least_area=5.0, degrees=30.0, uv_grid=2.5)


@query
def detect_facades(spark, d):
    found, members = detect.detect(scene.points(spark, d), DETECT)
    return found.select("facade_id", "type", "point_count", *planes.PLANE, "area", "area_bbox", "flatness_rmse")


@query
def segment_selection(spark, d):
    p = scene.points(spark, d)
    chosen = p.where("facade_id in (0, 2) and x < 15").select("point_id")
    found, members = detect.segment(p, chosen, detect.Detection(degrees=30.0, least_cluster=80, least_area=0.0, trials=800))
    return members.groupBy("facade_id").agg(F.count("*").alias("points"))


@query
def points_near_facade(spark, d):
    """All points that lie where the first wall is, five metres within its bounds."""
    p = scene.points(spark, d)
    record = planes.records(p, planes.fit(p, "facade_id"), "facade_id").where("facade_id = 0").first()
    return planes.near_facade(p, record, 0.1, -5.0).select("point_id")


@query
def facade_ranking(spark, d):
    p = scene.points(spark, d).withColumn("facade", F.col("facade_id") * 10 + F.col("l_linenumber"))
    records = planes.records(p, planes.fit(p, "facade"), "facade")
    return detect.ranked(records).select("facade", "facade_id", "type", "point_count")


@query
def facade_labels(spark, d):
    p = scene.points(spark, d)
    near = planes.with_plane(p, scene.facades(spark), "facade_id").where(g.distance(P, planes.PLANE) <= 0.003).select("facade_id", "point_id")
    return detect.dense_labels(p.select("point_id"), near)


def _quality(spark, d, digits=None):
    """Intervals of 20 m; all windows of 2 m in steps of 0.05 m."""
    p = scene.points(spark, d).select("facade_id", "point_id", *P)
    walls = planes.fit(p, "facade_id", exact=digits is not None).where("facade_id < 2")
    kept, own = map(stored, q.intervals(p, walls, 20.0, LEAST, digits=digits))
    return kept, own, q.windows(kept, own, least=LEAST, digits=digits)


@query
def quality_windows(spark, d):
    """Places are in whole micrometres, so that no window's points depend on the last bits of a plane."""
    return _quality(spark, d, 6)[2]


@query
def quality_intervals(spark, d):
    return q.interval_results(*_quality(spark, d)).select("facade_id", "interval_id", "point_count", "windows", "gap", "verticality", "deviation", "compliant")


@query
def quality_overall(spark, d):
    return q.overall(q.interval_results(*_quality(spark, d)))


@query
def quality_levels(spark, d):
    return q.level_results(_quality(spark, d)[2], 0.001)


@query
def quality_weighted(spark, d):
    kept, _, found = _quality(spark, d)
    return q.weighted_overall(q.level_results(found, 0.001), kept)


@query
def point_levels(spark, d):
    kept, own, found = _quality(spark, d)
    return q.point_levels(kept, own, found, limit=0.001).groupBy("facade_id", "interval_id", "level").agg(F.count("*").alias("points"))


@query
def flatness_metrics(spark, d):
    """Spread, deviation and RMSE of signed distances to the group's own plane."""
    p = scene.points(spark, d)
    own = planes.with_plane(p, planes.fit(p, "facade_id", "l_linenumber"), "facade_id", "l_linenumber").withColumn("s", g.signed_distance(P, planes.PLANE))
    s = F.col("s")
    return own.groupBy("facade_id", "l_linenumber").agg((F.max(s) - F.min(s)).alias("gap"), F.stddev_pop(s).alias("std"), F.sqrt(F.avg(s * s)).alias("rmse"))


@query
def hull_area(spark, d):
    p = scene.points(spark, d)
    return detect.hull_area(p, scene.facades(spark), "facade_id").select("facade_id", "area_hull")


@query
def segment_dimensions(spark, d):
    return detect.dimensions(scene.points(spark, d), scene.facades(spark), "facade_id")


@query
def project_points(spark, d):
    return photo.project_points(scene.points(spark, d), scene.POSE).select("point_id", "px", "py", "depth")


@query
def points_in_quad(spark, d):
    return photo.in_photo_quadrilateral(scene.points(spark, d), scene.POSE, scene.QUAD).select("point_id", "facade_id")


@query
def facade_in_photo(spark, d):
    return photo.facade_in_quadrilateral(scene.points(spark, d), scene.POSE, scene.QUAD)


@query
def largest_visible_facade(spark, d):
    return photo.largest_visible_facade(scene.points(spark, d), scene.facades(spark), scene.POSE, 1920, 1080)


@query
def snap_to_plane(spark, d):
    o = scene.read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_totalprice") / 20000).alias("x"), F.pmod("o_custkey", F.lit(40)).cast("double").alias("y"), F.pmod("o_orderkey", F.lit(30)).cast("double").alias("z"))
    return photo.snap(o, scene.facades(spark))


CORNERS = [(5.0, 0.0, 40.0), (18.0, 0.0, 38.0), (17.0, 0.0, 15.0), (6.0, 0.0, 17.0)]


@query
def refine_corners(spark, d):
    wall = scene.points(spark, d).where("facade_id = 0")
    return photo.refine_corners(wall, scene.POSE, scene.QUAD, CORNERS)


@query
def points_in_3d_quad(spark, d):
    return photo.in_3d_quadrilateral(scene.points(spark, d), scene.FACADES[3][1:5], [(5.0, 5.0, 5.0), (15.0, 6.0, 6.0), (14.0, 15.0, 15.0), (6.0, 14.0, 14.0)]).select("point_id")


@query
def heatmap_cells(spark, d):
    return photo.heatmap(scene.points(spark, d).where("facade_id = 0"), (0.0, 1.0, 0.0, 0.0), cell=2.0)


@query
def photo_heatmap(spark, d):
    return photo.photo_heatmap(scene.points(spark, d), scene.facades(spark), scene.POSE, scene.QUAD, cell=2.0).select("i", "j", "value", "points")


@query
def highlight_colors(spark, d):
    p = scene.points(spark, d).join(F.broadcast(scene.facades(spark).select("facade_id", "type")), "facade_id")
    return photo.highlight(p, 1).select("point_id", "show_r", "show_g", "show_b")


@query
def label_colors(spark, d):
    p = scene.points(spark, d).join(F.broadcast(scene.facades(spark).select("facade_id", "type")), "facade_id")
    shown = F.when(F.col("l_linenumber") <= 5, F.col("type"))
    return p.select("point_id", *rgb(colours.by_type(shown, colours.dimmed(colours.channels(), 0.35))))


@query
def uniform_colors(spark, d):
    return pts.is_uniform(scene.points(spark, d), "facade_id", "l_linenumber")


@query
def rigid_align(spark, d):
    """Recovers a known motion from every point and its moved twin."""
    p = scene.points(spark, d)
    moved = g.rigid(P, MOVE)
    m = register.align_pairs(p.select(*[F.col(c).alias(f"s{c}") for c in P], *[k.alias(f"t{c}") for k, c in zip(moved, P, strict=True)]))
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(4) for j in range(4)], "i int, j int, value double")


@query
def apply_transform(spark, d):
    return pts.transform(scene.points(spark, d), MOVE).select("point_id", *P)


@query
def merge_clouds(spark, d):
    a, b = _two_scans(spark, d)
    return pts.merge(a.withColumns({c: F.lit(0.5) for c in "rgb"}), scene.points(spark, d).where("l_linenumber % 2 = 0"))


@query
def icp_refine(spark, d):
    """A small known motion undone by iterative closest point."""
    p = scene.points(spark, d)
    exact = scene.facades(spark).select("facade_id", *[F.col(k).alias(n) for k, n in zip(planes.PLANE, ("nx", "ny", "nz"), strict=False)])
    target = stored(p.select("facade_id", "point_id", *P).join(F.broadcast(exact), "facade_id"))
    small = math.radians(0.1)
    off = [[math.cos(small), -math.sin(small), 0.0, 0.02], [math.sin(small), math.cos(small), 0.0, -0.02], [0.0, 0.0, 1.0, 0.02]]
    source = stored(pts.transform(p.select("point_id", *P), off))
    m, share, rmse = register.icp(source, target, voxel=0.05, caps=(4, 4, 2), tolerance=1e-4)
    back = m @ np.vstack([np.array(off), [0, 0, 0, 1]])
    return spark.createDataFrame([(bool(np.abs(back - np.eye(4)).max() < 0.02), bool(share > 0.5))], "recovered boolean, overlaps boolean")


@query
def camera_pose(spark, d):
    """Known cameras recovered from all wall points before them: seven photos, some of known focal length, whose pixels are then off for a tenth of the pairs."""
    photo_id, off = F.col("l_linenumber").cast("int"), (F.col("l_linenumber") % 2 == 1) & (F.pmod("point_id", F.lit(1000)) % 10 == 3)
    seen = photo.project_points(scene.points(spark, d).where("facade_id in (0, 3)"), scene.POSE | {"distortion": [0.0]}).where("depth > 1")
    pairs = seen.select(photo_id.alias("photo_id"), F.col("point_id").alias("pair_id"), *P, (F.col("px") + F.when(off, 300.0).otherwise(0.0)).alias("px"), "py")
    numbers = spark.range(1, 8).select(F.col("id").cast("int").alias("photo_id"))
    focal = F.when(F.col("photo_id") % 2 == 1, 1000.0)
    photos = numbers.withColumns({"width": F.lit(1920.0), "height": F.lit(1080.0), "focal": focal, "degrees": F.lit(60.0)})
    got = pose.poses(photos, pairs, trials=20).where("message is null")
    exact = {"focal": F.round("focal", 1), "rmse": F.round("rmse", 2) + 0.0, "x": F.round(F.col("centre")[0], 2), "y": F.round(F.col("centre")[1], 2), "z": F.round(F.col("centre")[2], 2)}
    return got.select("photo_id", F.col("pairs").cast("long").alias("pairs"), "inliers", *[c.alias(n) for n, c in exact.items()])


@query
def lod_sample(spark, d):
    o = scene.read(spark, d, "orders")
    return pts.stride_sample(o.select(F.col("o_orderkey").alias("point_id"), "o_totalprice"), 7)


@query
def lod_stride(spark, d):
    """Every seventh order by place, not by key."""
    o = scene.read(spark, d, "orders")
    return pts.every_kth(o.select(F.col("o_orderkey").alias("point_id"), "o_totalprice"), 7, "point_id")


@query
def row_numbers(spark, d):
    """Places of line items by ship date and key."""
    l = scene.read(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return pts.numbered(l, *l.columns).select("l_orderkey", "l_linenumber", "number")


@query
def price_quantiles(spark, d):
    """Exact medians and 98th percentiles of prices by flag, by refined histograms."""
    l = scene.read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    low, high = (quantiles.quantiles(l, "v", s, "l_returnflag") for s in (0.5, 0.98))
    return low.withColumnRenamed("quantile", "median").join(high.select("l_returnflag", F.col("quantile").alias("high")), "l_returnflag")


@query
def rect_select_stride(spark, d):
    return photo.select_rectangle(scene.points(spark, d), scene.POSE, (900.0, 400.0), (1100.0, 600.0), 3, order=("point_id",)).select("point_id")


@query
def rect_select(spark, d):
    return photo.select_rectangle(scene.points(spark, d), scene.POSE, (900.0, 400.0), (1100.0, 600.0), 3).select("point_id")


@query
def nearest_pick(spark, d):
    return photo.nearest_pick(scene.points(spark, d), scene.POSE, 1000.0, 500.0, 8.0).select("point_id", "facade_id", "off", "depth")


def _files(spark, d):
    """orders as file assets of scenes (customers): some missing, some without scene, some deleted."""
    o = scene.read(spark, d, "orders")
    k = F.col("o_orderkey")
    policy = F.when(k % 3 == 0, "CACHE").when(k % 3 == 1, "PERSIST").otherwise("TEMP")
    return o.select(k.alias("id"), F.pmod("o_custkey", F.lit(20)).alias("project_id"), F.when(k % 11 != 0, F.col("o_custkey")).alias("scene_id"), F.lower(F.col("o_orderstatus")).alias("kind"), policy.alias("persist_policy"), F.concat(F.lit("/data/"), k.cast("string"), F.lit(".ply")).alias("path"), (k % 13 == 0).alias("is_deleted"))


@query
def catalog_gc(spark, d):
    f = _files(spark, d)
    scenes = scene.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("is_active"))
    return catalog.collect_garbage(f, scenes, f.where("id % 7 != 0").select("path")).select("id", "action")


@query
def catalog_missing(spark, d):
    f = _files(spark, d)
    return catalog.missing_paths(f, f.where("id % 5 != 0").select("path"), ["o", "f"]).select("id", "path")


@query
def catalog_listing(spark, d):
    """Customers as projects: newest first, the first fifty of those not deleted."""
    c = scene.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.col("c_custkey") * 37, F.lit(1000))).alias("created_at"), (F.col("c_nationkey") == 3).alias("is_deleted"))
    return catalog.listing(c, 50).select("id", "name")


@query
def catalog_upsert(spark, d):
    c = scene.read(spark, d, "customer")
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("c_custkey"))
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("project_uuid"), F.lit("old").alias("name"), F.lit("/old").alias("root_dir"), at.alias("created_at"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("project_uuid"), F.col("c_mktsegment").alias("name"), F.lit("/new").alias("root_dir"), at.alias("created_at"))
    return catalog.upsert_index(old, new).select("project_uuid", "name", "root_dir")


@query
def catalog_activate(spark, d):
    s = scene.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("project_id"), F.lit("X").alias("status"), (F.col("c_acctbal") > 0).alias("is_active"), F.lit(None).cast("timestamp").alias("activated_at"))
    return catalog.activate(s, 7, 30, F.timestamp_seconds(F.lit(1))).select("id", "status", "is_active")


@query
def catalog_soft_delete(spark, d):
    f = _files(spark, d)
    return catalog.soft_delete(f, f.where("id % 10 = 0").select("id"), F.timestamp_seconds(F.lit(1))).groupBy("project_id").agg(F.count(F.when(F.col("is_deleted"), 1)).alias("deleted"), F.count("*").alias("files"))


@query
def result_ids(spark, d):
    p = scene.read(spark, d, "part")
    name = F.concat(F.col("p_name"), F.lit(" scan.v1.ply"))
    voxel, area = F.col("p_size") / 100, F.col("p_size").cast("double")
    return p.select("p_partkey", names.registration_id(name, F.concat(F.col("p_brand"), F.lit(".ply")), voxel).alias("registration"), names.detection_id(name, F.col("p_partkey"), voxel, area).alias("detection"), names.cache_key(name, F.col("p_partkey"), voxel).alias("cache"))


@query
def file_kinds(spark, d):
    p = scene.read(spark, d, "part")
    ext = F.element_at(F.array(*map(F.lit, ("ply", "PCD", "jpg", "pdf", "docx", "xyz"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("C:\\scans\\"), F.col("p_name"), F.lit("."), ext)
    return p.select("p_partkey", names.file_kind(path).alias("kind"), names.safe_name(path).alias("name"))


@query
def conversion_jobs(spark, d):
    p = scene.read(spark, d, "part").select(F.concat(F.lit("/scans/"), F.col("p_partkey").cast("string"), F.lit("/"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")), F.lit(".fls")).alias("path"))
    return scans.conversion_jobs(p)


@query
def project_index(spark, d):
    s = scene.read(spark, d, "orders").select(F.pmod("o_custkey", F.lit(50)).alias("project"), F.col("o_orderpriority").alias("scan_name"), F.col("o_orderkey").alias("points"), F.lit("p").alias("path"))
    return scans.project_index(s).select("project", "scan_count", "total_points")


@query
def sidecar_parse(spark, d):
    e = scene.read(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), F.to_json(F.struct(F.col("event_type").alias("scanName"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("int")).alias("numRows"), F.col("value").alias("scannerRange_m"))).alias("json"))
    return scans.sidecars(e).select("path", F.col("scanName").alias("scan_name"), F.col("numRows").alias("num_rows"), F.col("scannerRange_m").alias("range_m"), F.col("distFactor").alias("factor"), F.col("scannerType").alias("scanner"))


@query
def ply_vertices(spark, d):
    p = scene.read(spark, d, "part")
    header = F.concat(F.when(F.col("p_partkey") % 4 != 0, "ply").otherwise("plx"), F.lit("\nformat ascii 1.0\nelement vertex "), F.col("p_partkey").cast("string"), F.lit("\nproperty float x\nend_header\n"))
    return p.select("p_partkey", scans.ply_vertex_count(header).alias("vertices"))


@query
def pick_debounce(spark, d):
    """Events of one user and type within half an hour of the last accepted one drop out."""
    e = scene.read(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return picks.debounce(e, ["user_id", "event_type"], 1_800_000).select("event_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flatness of the scene's walls, interval by interval."""
    return QUERIES["quality_intervals"](spark, sf_dir)
