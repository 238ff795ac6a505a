"""Values that must equal the reference's, by hand: axes, colours, names, levels at a wall's edge, selections too small."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import colours, names
from plumbline.functions import geometry as g
from plumbline.operators import detect, photo, planes, quality
from plumbline.operators import points as pts
from plumbline.operators.storage import stored


def test_axes_of_inclined_and_level_planes(spark):
    s = math.sqrt(0.5)
    for normal, u in (((0.0, s, -s), (1.0, 0.0, 0.0)), ((0.0, 0.0, 1.0), (0.0, 1.0, 0.0)), ((0.6, 0.0, 0.8), (0.0, -1.0, 0.0)), ((0.0, 1.0, 0.0), (-1.0, 0.0, 0.0))):
        row = spark.range(1).select(*[c for axis in g.plane_axes([F.lit(x) for x in normal]) for c in axis]).first()
        assert np.allclose(row[:3], u)
        want = (0.0, 0.0, 1.0) if abs(normal[2]) < 0.45 else np.cross(normal, u)
        assert np.allclose(row[3:], want)
        assert np.allclose(photo._axes(np.array(normal)), [row[:3], row[3:]])


def test_types(spark):
    got = spark.createDataFrame([(0.25,), (-0.26,), (0.85,)], "nz double").select(g.plane_type("nz")).collect()
    assert [r[0] for r in got] == ["vertical_facade", "inclined", "horizontal"]


def test_identifiers(spark):
    f = spark.createDataFrame([("/x/my scan.ply", "b.v2.ply", 0.05, 120, 5.0)], "p string, q string, v double, n long, a double")
    got = f.select(names.registration_id(f.p, f.q, f.v), names.cache_key(f.p, f.n, f.v), names.detection_id(F.lit("Süd wand.ply"), f.n, f.v, f.a)).first()
    assert got[0] == "my_scan__b.v2_v0p05" and got[1] == "my_scan_s120_v0p05.ply"
    assert got[2] == "facade_Süd_wand_ply_" + hashlib.sha1("Süd wand.ply|120|0.0500|5.00".encode()).hexdigest()[:12]
    values = [0.05, 0.1234567, 1.0, 12.5, 123456.7, 1234567.0, 0.0001234567, 0.00001, 0.0, 100.0]
    tags = [r[0] for r in spark.createDataFrame([(x,) for x in values], "v double").select(names.voxel_tag(F.col("v"))).collect()]
    assert tags == [f"{x:.6g}".replace(".", "p") for x in values]


def test_display_colours(spark):
    p = spark.createDataFrame([(1, 0, "vertical_facade"), (2, 1, "horizontal"), (3, 2, "odd"), (4, -1, None)], "point_id long, facade_id int, type string").withColumns({c: F.lit(1.0) for c in "rgb"})
    shown = {r.point_id: (r.show_r, r.show_g, r.show_b) for r in photo.highlight(p, 0).collect()}
    assert shown[1] == (0.2, 0.8, 0.2) and shown[2] == (0.12, 0.34, 0.5) and shown[3] == (0.18, 0.18, 0.18) and np.allclose(shown[4], 0.22)
    region = {r.point_id: r.show_g for r in photo.highlight_region(p, p.where("point_id = 2").select("point_id")).collect()}
    assert region[2] == 0.8 and abs(region[1] - 0.22) < 1e-12
    with pytest.raises(ValueError):
        photo.highlight_region(p, p.where("false").select("point_id"))
    parts = spark.createDataFrame([(0, 1), (9, 2)], "facade_id int, point_id long")
    cut = {r.point_id: (r.show_r, r.show_g, r.show_b) for r in photo.segment_colors(p, parts).collect()}
    assert cut[1] == (1.0, 0.2, 0.2) and cut[2] == (1.0, 0.85, 0.1) and np.allclose(cut[4], 0.25)
    heat = spark.createDataFrame([(-2.0,), (0.0,), (2.0,)], "v double").select(*colours.heat(F.col("v"), F.lit(1.0))).collect()
    assert np.allclose([tuple(r) for r in heat], [(0.03, 0.22, 1.0), (0.48, 0.48, 0.48), (1.0, 0.08, 0.02)])
    flat = p.select("point_id", *[F.lit(0.0).alias(c) for c in "xyz"], *[F.lit(0.5).alias(c) for c in "rgb"])
    merged = {(r.cloud, r.r, r.g, r.b) for r in pts.merge(flat, flat).collect()}
    assert merged == {("source", 1.0, 0.4, 0.4), ("target", 0.4, 0.4, 1.0)}


def flat_wall(spark, width, height, gap=0.05):
    rows = [(0, 0, i * 1000 + k, i * gap, 0.0, k * gap) for i in range(int(width / gap + 1e-9) + 1) for k in range(int(height / gap + 1e-9) + 1)]
    return stored(spark.createDataFrame(rows, "facade_id int, interval_id int, point_id long, x double, y double, z double"))


@pytest.mark.parametrize("step", [0.5, 0.35])
def test_points_past_the_last_window_have_no_level(spark, step):
    """Windows end before the wall does, and the ruler may be no multiple of the step."""
    wall = flat_wall(spark, 3.1, 2.6)
    own = stored(planes.fit(wall, "facade_id", "interval_id"))
    found = quality.windows(wall, own, step=step, least=5, most=None)
    levels = {r.point_id: r.level for r in quality.point_levels(wall, own, found, step=step).collect()}
    rows = wall.collect()
    assert len(levels) == len(rows)
    sign = -1 if own.first().nb > 0 else 1
    u = {r.point_id: sign * r.x for r in rows}
    low_u, low_z = min(u.values()), min(r.z for r in rows)
    spans = [(low_u + w.ku * step, low_z + w.kv * step) for w in found.collect()]
    for r in rows:
        x, z = u[r.point_id], r.z
        # how far inside its best window a point lies; points on an edge are left to rounding
        depth = max(min(x - a, a + 2 - x, z - b, b + 2 - z) for a, b in spans)
        assert abs(depth) < 1e-6 or levels[r.point_id] == (0 if depth > 0 else -1)
    assert -1 in levels.values() and 0 in levels.values()


def test_window_sums_equal_listed_windows(spark):
    """Sums dealt along u and v equal each window's own points, both bounds closed, with a stride too."""
    wall = flat_wall(spark, 3.1, 2.6).withColumn("y", F.sin(F.col("x") * 3 + F.col("z")) * 0.01).transform(stored)
    own = stored(planes.fit(wall, "facade_id", "interval_id"))
    flat, span = quality._spans(wall, own, 2.0, 0.25)
    points, s = flat.collect(), span.first()
    for most in (None, 6):
        got = {(r.ku, r.kv): (r.points, r.gap) for r in quality.windows(wall, own, step=0.25, least=1, most=most).collect()}
        stride = math.ceil(math.sqrt(s.nu * s.nv / most)) if most else 1
        want = {}
        for ku in range(0, s.nu, stride):
            for kv in range(0, s.nv, stride):
                own_points = [p.s for p in points if s.ou + ku * 0.25 <= p.u <= s.ou + ku * 0.25 + 2 and s.ov + kv * 0.25 <= p.v <= s.ov + kv * 0.25 + 2]
                want[ku, kv] = (len(own_points), abs(sum(own_points) / len(own_points)))
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_a_selection_that_is_too_small_gives_no_segments(spark):
    cloud = spark.createDataFrame([(i, float(i), 0.0, 0.0, 0.0, 1.0, 0.0) for i in range(20)], "point_id long, x double, y double, z double, nx double, ny double, nz double")
    segments, members = detect.segment(cloud, cloud.select("point_id"))
    assert segments.count() == members.count() == 0
    rows = [(i * 20 + k, i * 0.1, 0.0, k * 0.1, 0.0, 1.0, 0.0) for i in range(9) for k in range(10)]
    cloud = spark.createDataFrame(rows, cloud.schema)
    segments, members = detect.segment(cloud, cloud.select("point_id"), detect.Detection(degrees=18.0, least_cluster=80, least_area=0.0, trials=20))
    assert segments.count() == 1 and members.count() == 90 and segments.first().type == "vertical_facade"


def test_empty_quality_record(spark):
    r = quality.empty_overall(spark, levels=True).first()
    assert r.type == "unknown" and r.gap == 0 and r.compliance == 1.0 and r.unassessed == 0
