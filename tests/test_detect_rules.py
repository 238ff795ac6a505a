"""Rules of detection and segmentation on clouds made by hand."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import components, detect, planes

CLOUD = "point_id long, x double, y double, z double, nx double, ny double, nz double"


def cloud(spark, points, normal=(0.0, 1.0, 0.0), start=0):
    return spark.createDataFrame([(start + i, *map(float, p), *normal) for i, p in enumerate(points)], CLOUD)


def grid(w, h, step=0.1, at=(0.0, 0.0, 0.0)):
    return [(at[0] + i * step, at[1], at[2] + j * step) for i in range(w) for j in range(h)]


def test_the_whole_cluster_of_a_segment_is_taken_out(spark):
    """A wall with a fringe beyond two tolerances but linked to it: the fringe does not come back as a segment."""
    wall = grid(40, 30)
    fringe = [(x, 0.053, z) for x, _, z in grid(20, 10)]  # within 1.8 tolerances of the seed, over two of the refitted plane's? kept with the cluster
    far = [(x + 0.05, 0.5, z) for x, _, z in grid(20, 10, at=(0.0, 0.0, 0.0))]
    p = cloud(spark, wall + fringe + far)
    o = detect.Detection(voxel=0.02, tolerance=0.03, degrees=18.0, least_cluster=80, least_area=0.0, trials=60)
    segments, members = detect.segment(p, p.select("point_id"), o)
    ids = {}
    for r in members.collect():
        ids.setdefault(r.facade_id, set()).add(r.point_id)
    n = len(wall)
    in_fringe = {f for f, s in ids.items() if any(n <= i < n + 200 for i in s)}
    assert in_fringe <= {0} and len(ids) == 2  # the wall, and the sheet behind it
    assert all(i >= n + 200 for i in ids[1]) and segments.count() == 2


def test_segments_have_records_labels_and_a_message(spark):
    p = cloud(spark, grid(30, 20) + grid(12, 10, at=(10.0, 0.0, 0.0)))
    o = detect.Detection(voxel=0.05, degrees=18.0, least_cluster=80, least_area=0.0, trials=60)
    records, labels, message = detect.segment_region(p, p.select("point_id"), o)
    rows = sorted(records.collect(), key=lambda r: r.facade_id)
    assert message == "2 local planes found" and [r.point_count for r in rows] == [600, 120]  # the larger cluster first
    assert [(round(r.width, 6), round(r.height, 6), round(r.area, 6)) for r in rows] == [(2.9, 1.9, 5.51), (1.1, 0.9, 0.99)]
    assert rows[0].color != rows[1].color
    assert {r.facade_id: r["count"] for r in labels.groupBy("facade_id").count().collect()} == {0: 600, 1: 120}
    none, dense, message = detect.segment_region(p, p.limit(79).select("point_id"), o)
    assert message == "too few points selected" and none.count() == 0 and dense.where("facade_id = -1").count() == 720
    unknown = p.select((F.col("point_id") + 100_000).alias("point_id"))
    assert detect.segment_region(p, unknown, o)[2] == "too few valid points selected"


def test_detection_filters_on_the_hull(spark):
    """A thin cross: its box is five times its hull; only the box is large enough."""
    a = [(0.05 * i, 0.0, 0.05 * i) for i in range(120)]
    band = [(x + 0.02 * k, 0.0, z) for x, _, z in a for k in range(6)]  # a slanted band: box 36, hull 0.7
    square = grid(40, 40, at=(20.0, 0.0, 0.0))
    o = detect.Detection(voxel=0.05, least_area=5.0, least_cluster=100, uv_grid=0.3, trials=60, rounds=4)
    found, _ = detect.detect(cloud(spark, band + square), o)
    rows = found.collect()
    assert [r.point_count for r in rows] == [1600] and abs(rows[0].area - 3.9 * 3.9) < 1e-6


def test_adaptive_grid_splits_what_a_fixed_one_joins(spark):
    left, right = grid(40, 40), grid(40, 40, at=(4.4, 0.0, 0.0))  # a gap of half a metre
    o = {"voxel": 0.3, "least_area": 1.0, "least_cluster": 100, "trials": 40, "rounds": 3}
    p = cloud(spark, left + right)
    assert [r.point_count for r in detect.detect(p, detect.Detection(**o))[0].collect()] == [3200]
    assert [r.point_count for r in detect.detect(p, detect.Detection(**o, adaptive=2.0))[0].collect()] == [1600, 1600]


def test_points_in_one_place_are_one_component(spark):
    f = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0 + 1e-7, 1.0), (2, 0.0, 0.0), (2, 5.0, 0.0), (3, 0.0, 0.0), (3, 2e-6, 0.0)], "f int, u double, v double")
    got = components.grid_components(f, 0.5, 2, "f").collect()
    assert {r.f for r in got} == {1}
    assert components.adaptive_size(spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "point_id long, x double, y double, z double"), 0.1) == 0.25
    assert np.isfinite(1.0) and planes.PLANE


def test_planes_are_counted_in_one_pass(spark):
    """500 planes over points that lie on, just within and just beyond the tolerance, one job for all planes."""
    rng = np.random.default_rng(3)
    xyz = np.concatenate((rng.uniform(-3, 3, (2000, 3)), [[0.0, 0.0, h] for h in (0.05, 0.05 + 1e-15, -0.05, np.inf, np.nan)]))
    drawn = [(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, -1.0, 0.0)] + [tuple(map(float, (*(n / np.linalg.norm(n)), d))) for n, d in zip(rng.normal(size=(498, 3)), rng.uniform(-1, 1, 498), strict=True)]
    p = cloud(spark, xyz)
    want = [sum(p.agg(F.count(F.when(planes.g.distance(("x", "y", "z"), q) <= 0.05, 1))).first()) for q in drawn[:3]]
    assert [planes.ransac(p, [q], 0.05) for q in drawn[:3]] == [(0, n) for n in want]
    sc = spark.sparkContext
    sc.setJobGroup("ransac", "one pass")
    best, n = planes.ransac(p, drawn, 0.05)
    jobs = len(sc.statusTracker().getJobIdsForGroup("ransac"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2 and n == planes.ransac(p, [drawn[best]], 0.05)[1] >= max(want)
    assert planes.ransac(p, [drawn[best], drawn[best]], 0.05) == (0, n) and planes.ransac(p.where("false"), drawn, 0.05) == (0, 0)
