"""Records around the clouds: projects with scenes and files, conversion results, picked pairs, detection responses."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import colours, names
from plumbline.functions import geometry as g
from plumbline.operators import catalog, detect, register
from plumbline.sources import scans


def now():
    return F.timestamp_seconds(F.lit(7))


def tables(spark):
    return [spark.createDataFrame([], t) for t in (catalog.PROJECTS, catalog.SCENES, catalog.INDEX, catalog.FILES)]


def test_a_project_has_an_active_scene_and_an_index_row(spark):
    projects, scenes, index, _ = tables(spark)
    projects, scenes, index = catalog.create_project(projects, scenes, index, "u1", "one", "/p/u1", now(), remarks="r")
    projects, scenes, index = catalog.create_project(projects, scenes, index, "u2", "two", "/p/u2", now())
    assert [(r.id, r.uuid, r.remarks) for r in projects.orderBy("id").collect()] == [(1, "u1", "r"), (2, "u2", None)]
    assert [(r.project_id, r.name, r.is_active) for r in scenes.orderBy("id").collect()] == [(1, "Scene 1", True), (2, "Scene 1", True)]
    assert [(r.project_uuid, r.root_dir) for r in index.orderBy("id").collect()] == [("u1", "/p/u1"), ("u2", "/p/u2")]
    left, none = catalog.cascade(projects.where("uuid = 'u2'"), scenes, scenes.limit(0))
    assert [r.project_id for r in left.collect()] == [2] and none.count() == 0
    with pytest.raises(ValueError):
        catalog.project_id(projects, "u3")


def test_files_are_imported_and_judged_on_activation(spark):
    projects, scenes, index, files = tables(spark)
    projects, _, _ = catalog.create_project(projects, scenes, index, "u1", "one", "/p/u1", now())
    listed = spark.createDataFrame([("/in/a.PLY", 5, "aa")], "path string, size_bytes long, sha256 string")
    scenes, files = catalog.import_files(projects, scenes, files, listed, "u1", "raw_pointcloud", now())
    scenes, files = catalog.import_files(projects, scenes, files, listed, "u1", "raw_pointcloud", now(), copy=True)
    scenes, files = catalog.import_files(projects, scenes, files, listed, "u1", "downsampled", now())
    got = [(r.id, r.scene_id, r.persist_policy, r.path, r.original_name, r.ext) for r in files.orderBy("id").collect()]
    assert got == [(1, 1, "PERSIST", "/in/a.PLY", "a.PLY", ".ply"), (2, 1, "PERSIST", "/p/u1/raw/a.PLY", "a.PLY", ".ply"), (3, 1, "CACHE", "/p/u1/cache/a.PLY", "a.PLY", ".ply")]
    scenes = catalog.append(scenes, spark.createDataFrame([(1, "Scene 2", False)], "project_id long, name string, is_active boolean"))
    present = files.where("id != 2").select("path")
    after, judged, missing = catalog.load_and_activate(projects, scenes, files, present, "u1", now(), 2)
    assert [r.is_active for r in after.orderBy("id").collect()] == [False, True]
    assert {r.id: r.action for r in judged.collect()} == {1: "keep", 2: "missing", 3: "remove"}
    assert [r.id for r in missing.collect()] == [2]
    same, judged, _ = catalog.load_and_activate(projects, scenes, files, present, "u1", now())
    assert [r.is_active for r in same.orderBy("id").collect()] == [True, False] and judged.where("action = 'keep'").count() == 2
    idle, _, _ = catalog.load_and_activate(projects, scenes.withColumn("is_active", F.lit(False)), files, present, "u1", now())
    assert [r.id for r in idle.where("is_active").collect()] == [1]


def test_conversion_results(spark):
    jobs = spark.createDataFrame([(k, f"{k}.ply") for k in "abcdefgh"], "path string, output string")
    existing = spark.createDataFrame([("a.ply", 9), ("b.ply", None)], "output string, points long")
    attempts = spark.createDataFrame([("a", 0, True, 4), ("c", 0, True, 3), ("d", 1, True, 3), ("e", 0, False, None), ("f", 0, True, None), ("g", 0, True, 0), ("h", None, False, None)], "path string, exit_code int, written boolean, points long")

    def run(**options):
        return {r.path: (r.status, r.points, r.remove) for r in scans.conversion_results(jobs, existing, attempts, **options).collect()}

    got = run()
    assert got["a"] == ("SKIPPED", 9, False) and got["b"] == ("FAILED", None, False) and got["c"] == ("OK", 3, False)
    assert {k: got[k][0] for k in "defgh"} == dict.fromkeys("defgh", "FAILED")
    assert [got[k][2] for k in "defgh"] == [True, False, True, True, False]
    assert run(keep_empty=True)["g"] == ("OK", 0, False)
    assert run(overwrite=True)["a"] == ("OK", 4, False)
    assert run(dry_run=True)["c"] == ("DRY_RUN", None, False) and run(dry_run=True)["a"][0] == "SKIPPED"


def test_pairs_replace_the_earlier_ones(spark):
    columns = "pair_id long, sx double, sy double, sz double, tx double, ty double, tz double"
    picked = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], columns)
    table = spark.createDataFrame([], f"source string, target string, {columns}")
    table = register.record_pairs(table, "a", "b", picked.union(picked))
    table = register.record_pairs(table, "a", "c", picked)
    table = register.record_pairs(table, "a", "b", picked)
    assert sorted(tuple(r) for r in table.collect()) == [("a", t, 1, 1.0, -3.0, 2.0, 4.0, -6.0, 5.0) for t in "bc"]


def test_response(spark):
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 1.0, 0.5, 0.0), (1, 0.0, 0.0, 0.0, None, None, None)], "point_id long, x double, y double, z double, r double, g double, b double")
    facades = spark.createDataFrame([(0, "horizontal")], "facade_id int, type string")
    labels = spark.createDataFrame([(0, -1), (1, 0)], "point_id long, facade_id int")
    got = {r.point_id: r for r in detect.response(points, facades, labels).collect()}
    assert (got[0].x, got[0].y, got[0].z, got[0].nx) == (1.0, 2.0, 3.0, 0.0)
    assert [round(v, 6) for v in (got[0].r, got[0].g, got[0].b)] == [0.35, 0.175, 0.0]
    assert [round(v, 6) for v in (got[1].r, got[1].g, got[1].b)] == list(colours.BY_TYPE["horizontal"])
    for wrong in (labels.limit(1), labels.union(labels.limit(1)), spark.createDataFrame([(0, 0), (0, 0)], "point_id long, facade_id int")):
        with pytest.raises(ValueError):
            detect.response(points, facades, wrong)


def test_small_rules(spark):
    f = spark.createDataFrame([("a.PLY", 50.0, 2.0, None, 0.5), ("b.webp", 500.0, -1.0, 0.1, 0.5), ("c.txt", float("nan"), 0.2, 0.1, 0.5)], "p string, f double, r double, g double, b double")
    got = f.select(names.raw_kind(f.p), g.sane_focal("f", 1000, 800, 900), *colours.clipped()).collect()
    assert [tuple(r) for r in got] == [("raw_pointcloud", 900.0, 0.7, 0.7, 0.7), ("raw_image", 500.0, 0.0, 0.1, 0.5), (None, 900.0, 0.2, 0.1, 0.5)]
