"""Scans found from a root, and converter logs as records."""

import pytest

from plumbline.sources import conversion

LOG = """[INFO] Found 3 scan(s)
[WARN] laser was warm
[OK] Exported: C:\\out\\pointclouds\\Scan_001.v2.ply (1200 points, 3 s)
Loading the next
[ERROR] scan 2 has no index
[WARN] trying again
[OK] Exported: C:\\out\\pointclouds\\Scan 002.ply (34 points)
[WARN] left over
""".splitlines()


def make(root, files, folders=()):
    for f in folders:
        (root / f).mkdir(parents=True, exist_ok=True)
    for f, n in files.items():
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_bytes(b"x" * n)


def test_discovery_walks_from_a_root(spark, tmp_path):
    make(
        tmp_path,
        {"a/one.fls": 5, "a/empty.fls": 0, "a/deep/er/two.FLS": 1, "b/pack.fls/Main": 9, "b/pack.fls/inner.fls": 9, "b/pack.fls/nested.fls/x": 1, "b/other.txt": 3, "c/twin/x": 1},
        ["c/twin.fls", "hollow"],
    )
    got = {(r.path.removeprefix(f"{tmp_path}/"), r.expanded) for r in conversion.discover(spark, str(tmp_path)).collect()}
    assert got == {("a/one.fls", False), ("a/deep/er/two.FLS", False), ("b/pack.fls", True), ("c/twin.fls", True)}
    seen = {r.path.removeprefix(f"{tmp_path}/") for r in conversion.walk(spark, str(tmp_path)).collect()}
    assert "b/pack.fls" in seen and not any(p.startswith("b/pack.fls/") for p in seen)  # not entered
    assert [tuple(r) for r in conversion.discover(spark, f"{tmp_path}/b/pack.fls").collect()] == [(f"{tmp_path}/b/pack.fls", True)]
    assert [tuple(r) for r in conversion.discover(spark, f"{tmp_path}/a/one.fls").collect()] == [(f"{tmp_path}/a/one.fls", False)]
    assert conversion.discover(spark, f"{tmp_path}/hollow").count() == 0
    with pytest.raises(FileNotFoundError):
        conversion.discover(spark, f"{tmp_path}/missing")


def log(spark, **runs):
    return spark.createDataFrame([(r, i, t) for r, lines in runs.items() for i, t in enumerate(lines)] or [], "run string, line long, text string").repartition(3)


def test_log_becomes_one_row_a_scan(spark):
    got = conversion.exported_scans(log(spark, a=LOG, b=[], c=["noise"])).orderBy("scan").collect()
    assert [tuple(r) for r in got] == [
        ("a", 1, 2, "C:\\out\\pointclouds\\Scan_001.v2.ply", "C:\\out\\pointclouds\\Scan_001.v2.json", 1200, ["[WARN] laser was warm"]),
        ("a", 2, 6, "C:\\out\\pointclouds\\Scan 002.ply", "C:\\out\\pointclouds\\Scan 002.json", 34, ["[ERROR] scan 2 has no index", "[WARN] trying again"]),
    ]


def test_runs_say_how_they_ended(spark):
    lines = log(spark, a=LOG, b=["[INFO] Found 2 scan(s)"], c=LOG, d=[], e=LOG)
    exits = spark.createDataFrame([("a", 0, 1.26), ("b", 0, 1.0), ("c", 3221225781, 1.0), ("d", -1073741819, 0.0), ("e", None, 9.0)], "run string, exit_code long, elapsed_s double")
    got = {r.run: (r.found, r.exported, r.points, r.success, r.message) for r in conversion.conversion_runs(lines, exits).collect()}
    assert got == {
        "a": (3, 2, 1234, True, "exported 2 of 3 scans, 1234 points, 1.3 s"),
        "b": (2, 0, 0, False, "no scans were found"),
        "c": (3, 2, 1234, False, "the converter ended with code 3221225781 (a runtime library is missing)"),
        "d": (0, 0, 0, False, "the converter ended with code -1073741819 (access violation in the scanner's library)"),
        "e": (3, 2, 1234, False, "the converter ran out of time"),
    }


def test_scans_get_their_sidecars(spark):
    texts = spark.createDataFrame([("C:\\out\\pointclouds\\Scan_001.v2.json", '{"scanName": "first", "numCols": 7}'), ("elsewhere.json", "{}")], "path string, json string")
    got = conversion.scan_records(log(spark, a=LOG), texts).orderBy("scan").collect()
    assert [(r.scanName, r.numCols, r.numRows, r.points) for r in got] == [("first", 7, 0, 1200), ("", 0, 0, 34)]
    assert got[1].transformToGlobal[0] == [1.0, 0.0, 0.0, 0.0]
    bad = spark.createDataFrame([("C:\\out\\pointclouds\\Scan 002.json", "{no json")], "path string, json string")
    assert [r.scanName for r in conversion.scan_records(log(spark, a=LOG), bad).collect()] == ["", ""]
    assert conversion.scan_records(log(spark), texts).count() == 0
