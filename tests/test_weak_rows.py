"""Photo regions, saved transformations, denoising, picks and uploads, from rows made by hand."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import catalog, neighbors, photo, register
from plumbline.sources import upload

POSE = {"camera_matrix": [[100.0, 0.0, 50.0], [0.0, 100.0, 50.0], [0.0, 0.0, 1.0]], "rotation": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], "translation": [0.0, 0.0, 0.0]}
FACADES = "facade_id int, na double, nb double, nc double, nd double, cx double, cy double, cz double, area double"


@pytest.fixture(scope="module")
def walls(spark):
    """A wall ten metres before the camera and a smaller one behind it, out of view."""
    rows = [(0, i * 100 + j, i * 0.1 - 3, j * 0.1 - 3, 10 + 0.01 * (i % 2)) for i in range(60) for j in range(60)] + [(1, 10_000 + i, i * 0.1, 0.0, -5.0) for i in range(50)]
    points = spark.createDataFrame(rows, "facade_id int, point_id long, x double, y double, z double")
    return points, spark.createDataFrame([(0, 0.0, 0.0, 2.0, -20.0, 0.0, 0.0, 10.0, 36.0), (1, 0.0, 0.0, 1.0, 5.0, 2.0, 0.0, -5.0, 900.0)], FACADES)


def test_region_and_heatmaps_with_and_without_a_polygon(spark, walls):
    points, facades = walls
    quad = [(40.0, 40.0), (60.0, 40.0), (60.0, 60.0), (40.0, 60.0)]
    region = photo.photo_region(points, facades, POSE, quad, refine=False)
    assert (region.facade_id, region.area) == (0, 36.0) and region.plane == [0.0, 0.0, -1.0, 10.0]  # turned to the camera, unit
    assert [[round(c, 6) for c in p] for p in region.corners_3d] == [[-1.0, -1.0, 10.0], [1.0, -1.0, 10.0], [1.0, 1.0, 10.0], [-1.0, 1.0, 10.0]]
    assert region.points.where("abs(x) > 1.0001 or abs(y) > 1.0001").count() == 0 and region.points.count() >= 19 * 19
    given = photo.photo_region(points, facades, POSE, quad, corners_3d=[(-2, -2, 10), (0, -2, 10), (0, 0, 10), (-2, 0, 10)])
    assert given.points.where("x > 0.0001").count() == 0
    whole = photo.visible_wall(points, facades, POSE, 100, 100)
    assert whole.facade_id == 0 and whole.points.count() == 3600 and whole.visible > 0.9
    cells = photo.photo_heatmap(points, facades, POSE, size=(100, 100), cell=1.0)
    assert cells.agg(F.sum("points")).first()[0] == 3600
    assert photo.photo_heatmap(points, facades, POSE, quad, cell=1.0).agg(F.sum("points")).first()[0] < 600
    with pytest.raises(ValueError, match="size"):
        photo.photo_heatmap(points, facades, POSE)
    with pytest.raises(ValueError, match="four corners"):
        photo.photo_region(points, facades, POSE, quad, corners_3d=[(0, 0, 0)])
    with pytest.raises(ValueError, match="visible"):
        photo.visible_wall(points.where("facade_id = 1"), facades, POSE, 100, 100)


def test_a_plane_without_normal_is_an_error():
    assert g.unit_plane((0, 3, 4, 10)) == [0.0, 0.6, 0.8, 2.0]
    for bad in ((0, 0, 0, 1), (math.nan, 0, 0, 1)):
        with pytest.raises(ValueError, match="no normal"):
            g.unit_plane(bad)


def test_saved_transformation_is_applied_and_measured(spark, walls):
    points = walls[0].where("facade_id = 0").select("point_id", "x", "y", "z")
    m = [[1, 0, 0, 0.0], [0, 1, 0, 0.0], [0, 0, 1, 0.5], [0, 0, 0, 1]]
    for given in (m, [c for row in m for c in row]):
        moved, rmse, overlap = register.apply_saved(points, points, given)
        assert overlap == 1.0 and 0.48 <= rmse <= 0.5 and moved.where("z > 10.4").count() == 3600
    far, rmse, overlap = register.apply_saved(points, points, [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 5.0], [0, 0, 0, 1]])
    assert (rmse, overlap) == (math.inf, 0.0)
    with pytest.raises(ValueError, match="4 x 4"):
        register.apply_saved(points, points, [1.0, 2.0])


def test_denoise(spark):
    rows = [(i, 0.01 * i, 0.0, 0.0) for i in range(100)] + [(1000, 50.0, 0.0, 0.0)]
    cloud = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    assert neighbors.denoise(cloud, 0.05, least=5).count() == 100
    assert neighbors.denoise(cloud, 0.05, "statistical", k=4).count() == 100
    assert neighbors.denoise(cloud, 0.05, least=500).count() == 101  # hardly any would stay
    assert neighbors.denoise(cloud, 0.05, least=500, safe=False).count() == 0
    with pytest.raises(ValueError, match="unknown method"):
        neighbors.denoise(cloud, 0.05, "median")


def test_picks_over_clouds_and_scaled_screens(spark):
    rows = [("b", 5, 0.0, 0.0, 10.0), ("a", 9, 0.0, 0.0, 10.0), ("a", 1, 1.0, 0.0, 10.0), ("a", 2, 0.0, 0.0, -1.0)]
    clouds = spark.createDataFrame(rows, "cloud string, point_id long, x double, y double, z double")
    assert [(r.cloud, r.point_id) for r in photo.nearest_pick(clouds, POSE, 50.0, 50.0, 3.0).collect()] == [("a", 9)]
    assert photo.nearest_pick(clouds, POSE, 120.0, 100.0, 3.0, scale=2.0).first().point_id == 1  # pixel (60, 50) at two pixels each
    assert {r.point_id for r in photo.select_rectangle(clouds, POSE, (110.0, 90.0), (130.0, 110.0), scale=2.0).collect()} == {1}


def test_upload(spark, tmp_path):
    now = F.timestamp_seconds(F.lit(5))
    empty = lambda schema: spark.createDataFrame([], schema)
    projects, scenes, _ = catalog.create_project(empty(catalog.PROJECTS), empty(catalog.SCENES), empty(catalog.INDEX), "u", "one", "/root_dir", now)
    ply = b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n0 0 0\n0.01 0 0\n9 9 9\n"
    (tmp_path / "my scan.ply").write_bytes(ply)
    (tmp_path / "a.xyz").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "b.png").write_bytes(b"x")
    (tmp_path / "c.doc").write_bytes(b"x")
    _, files, cloud = upload.upload(projects, scenes, empty(catalog.FILES), str(tmp_path / "my scan.ply"), now, project_uuid="u")
    row = files.first()
    assert (row.original_name, row.kind, row.persist_policy, row.size_bytes) == ("my scan.ply", "raw_pointcloud", "PERSIST", len(ply)) and cloud.count() == 2
    _, files, cloud = upload.upload(projects, scenes, empty(catalog.FILES), str(tmp_path / "a.xyz"), now)
    assert files.count() == 0 and cloud.count() == 2
    _, files, cloud = upload.upload(projects, scenes, empty(catalog.FILES), str(tmp_path / "b.png"), now, project_uuid="u")
    assert cloud is None and files.first().kind == "raw_image"
    with pytest.raises(ValueError, match="not supported"):
        upload.upload(projects, scenes, files, str(tmp_path / "c.doc"), now)
    with pytest.raises(FileNotFoundError):
        upload.upload(projects, scenes, files, str(tmp_path / "none.ply"), now)


def test_imports_without_an_active_scene_get_a_new_one(spark):
    now = F.timestamp_seconds(F.lit(5))
    empty = lambda schema: spark.createDataFrame([], schema)
    projects, scenes, _ = catalog.create_project(empty(catalog.PROJECTS), empty(catalog.SCENES), empty(catalog.INDEX), "u", "one", "/root_dir", now)
    idle = scenes.withColumns({"is_active": F.lit(False), "status": F.lit("inactive")})
    listed = spark.createDataFrame([("/x/a.ply", 1, "s")], "path string, size_bytes long, sha256 string")
    scenes, files = catalog.import_files(projects, idle, empty(catalog.FILES), listed, "u", "raw_pointcloud", now)
    assert sorted((r.id, r.is_active, r.status) for r in scenes.collect()) == [(1, False, "inactive"), (2, True, "active")] and files.first().scene_id == 2
    opened, _, _ = catalog.load_and_activate(projects, idle, empty(catalog.FILES), spark.createDataFrame([], "path string"), "u", now)
    assert [(r.id, r.is_active, r.status) for r in opened.collect()] == [(1, True, "inactive")]


def test_debounce_of_a_long_key_and_of_missing_values(spark):
    from plumbline.streaming import picks

    rows = [("a", 1, i * 40) for i in range(5000)] + [(None, 1, 0), (None, 1, 100), (None, 1, 150), ("b", None, 7), ("c", 2, None), ("c", 2, None), ("c", 2, 3)]
    df = spark.createDataFrame(rows, "cloud string, index int, ms long").selectExpr("cloud", "index", "timestamp_millis(ms) as ts").repartition(5)
    got = sorted((str(r.cloud), str(r["index"]), None if r.ts is None else round(r.ts.timestamp() * 1000)) for r in picks.debounce(df, ["cloud", "index"]).collect() if r.cloud != "c")
    want = sorted([("a", "1", t) for t in range(0, 200_000, 160)] + [("None", "1", 0), ("None", "1", 150), ("b", "None", 7)])
    assert got == want
    assert picks.debounce(df.where("cloud = 'c'"), ["cloud", "index"]).count() == 3 and picks.debounce(df.limit(0), ["cloud", "index"]).count() == 0
