"""Saved results, the catalog's rewrites, and names."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.operators import catalog, components, store
from plumbline.sources import scans


def test_saved_results(spark, tmp_path):
    path = f"{tmp_path}/detections"
    cloud = spark.range(10).withColumnRenamed("id", "point_id")
    for k, at in (("a", 1), ("b", 2)):
        head = spark.createDataFrame([(f"{k}.ply", 10, 0.05, 5.0, 1)], "source_filename string, point_count long, voxel_size double, min_area double, facade_count long").withColumn("created_at", F.timestamp_seconds(F.lit(at)))
        store.save(head, path, k, labels=cloud)
    assert [r.id for r in store.listing(spark, path, store.DETECTIONS).collect()] == ["b", "a"]
    assert store.load(spark, path, "a", "labels", expected=10).count() == 10
    try:
        store.load(spark, path, "a", "labels", expected=9)
        raise AssertionError("a wrong number of rows was accepted")
    except ValueError:
        pass


def _head(spark, k, at, facades=1):
    return spark.createDataFrame([(f"{k}.ply", 10, 0.05, 5.0, facades)], "source_filename string, point_count long, voxel_size double, min_area double, facade_count long").withColumn("created_at", F.timestamp_seconds(F.lit(at)))


def test_a_save_that_breaks_off_leaves_the_earlier_result(spark, tmp_path):
    """It fails between its two parts: the first is written anew, the second is not."""
    path, cloud = f"{tmp_path}/d", spark.range(10).withColumnRenamed("id", "point_id")
    store.save(_head(spark, "a", 1), path, "a", labels=cloud.withColumn("facade_id", F.lit(1)), members=cloud)
    broken = cloud.withColumn("facade_id", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.save(_head(spark, "b", 2), path, "a", labels=cloud.withColumn("facade_id", F.lit(2)), members=broken)
    assert {r.facade_id for r in store.load(spark, path, "a", "labels", expected=10).collect()} == {1}
    assert [r.source_filename for r in store.listing(spark, path, store.DETECTIONS).collect()] == ["a.ply"]
    store.save(_head(spark, "c", 3), path, "a", labels=cloud.withColumn("facade_id", F.lit(3)))
    assert {r.facade_id for r in store.load(spark, path, "a", "labels").collect()} == {3}
    assert [(r.source_filename, r.complete) for r in store.listing(spark, path, store.DETECTIONS).collect()] == [("c.ply", True)]
    assert store.prune(spark, path, "a") == 2 and store.prune(spark, path, "b") == 0
    assert store.load(spark, path, "a", "labels").count() == 10
    with pytest.raises(FileNotFoundError):
        store.load(spark, path, "a", "members")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path, "z", "labels")


def test_corrupt_manifests_are_left_out(spark, tmp_path):
    path = f"{tmp_path}/d"
    store.save(_head(spark, "a", 1), path, "a")
    (tmp_path / "d" / "header" / "b.json").write_text('{"created_at": "2024-01-0')
    assert [(r.id, r.complete) for r in store.listing(spark, path, store.DETECTIONS).collect()] == [("a", False)]


def test_labels_are_rebuilt_from_members(spark, tmp_path):
    path, cloud = f"{tmp_path}/d", spark.range(10).withColumnRenamed("id", "point_id")
    members = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 99)], "facade_id int, point_id long")
    store.save(_head(spark, "a", 1, 2), path, "a", members=members)
    got = {r.point_id: r.facade_id for r in store.load_labels(path, "a", cloud).collect()}
    assert got == {i: {1: 0, 2: 1}.get(i, -1) for i in range(10)}
    store.save(_head(spark, "a", 1, 2), path, "a", members=members, labels=cloud.withColumn("facade_id", F.lit(7)))
    assert {r.facade_id for r in store.load_labels(path, "a", cloud).collect()} == {7}
    with pytest.raises(ValueError, match="9 points"):
        store.load_labels(path, "a", cloud.limit(9))
    store.save(_head(spark, "a", 1, 0), path, "a", members=members.limit(0))
    with pytest.raises(ValueError, match="without facades"):
        store.load_labels(path, "a", cloud)


def test_thinned_cloud_is_reused(spark, tmp_path):
    cloud = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (0.01, 0.0, 0.0, 1.0, 1.0, 1.0)], "x double, y double, z double, r double, g double, b double")
    assert store.thinned(cloud, f"{tmp_path}/thin", 0.05).count() == 1
    assert store.thinned(cloud.limit(0), f"{tmp_path}/thin", 0.05).count() == 1


def test_catalog(spark):
    now = F.timestamp_seconds(F.lit(5))
    projects = catalog.append(spark.createDataFrame([], catalog.PROJECTS), spark.createDataFrame([("u1", "one", False), ("u2", "two", False)], "uuid string, name string, is_deleted boolean"))
    assert [(r.id, r.uuid) for r in projects.orderBy("id").collect()] in ([(1, "u1"), (2, "u2")], [(2, "u1"), (1, "u2")])
    renamed = catalog.update(projects, F.col("uuid") == "u1", name="uno", remarks=None, unknown=3)
    assert {r.name for r in renamed.collect()} == {"uno", "two"}
    one = renamed.where("name = 'uno'").first().id
    gone = catalog.soft_delete(renamed, spark.createDataFrame([(one,)], "id long"), now)
    assert [r.name for r in catalog.listing(gone).collect()] == ["two"]
    runs = catalog.start_run(spark.createDataFrame([], catalog.RUNS), 1, 2, "DETECT", "{}", now)
    done = catalog.finish_run(runs, 1, False, now, "/log").first()
    assert (done.status, done.log_path) == ("FAILED", "/log")
    rows = spark.createDataFrame([("/a/", "old", 1), ("/a", "new", 2)], "root_dir string, name string, created_at long")
    assert [(r.root_dir, r.name, r.times) for r in catalog.deduplicated_projects(rows).collect()] == [("/a", "new", 2)]


def test_names(spark):
    f = spark.createDataFrame([("/x/my scan (1).v2.ply", 0.05)], "p string, v double")
    got = f.select(names.safe_stem(f.p).alias("stem"), names.voxel_tag(f.v).alias("tag"), names.extension(f.p).alias("ext"), names.file_kind(f.p).alias("kind")).first()
    assert tuple(got) == ("my_scan_1_.v2", "0p05", "ply", "point_cloud")
    log = spark.createDataFrame([("start\nLoading a\r\nnoise\n 5 points ",)], "t string")
    assert log.select(scans.useful_lines(log.t)).first()[0] == "Loading a\n5 points"


def test_adaptive_size(spark):
    line = spark.createDataFrame([(i, i * 0.1, 0.0, 0.0) for i in range(300)], "point_id long, x double, y double, z double")
    assert abs(components.adaptive_size(line, 0.1, share=1.0) - 0.25) < 1e-9
