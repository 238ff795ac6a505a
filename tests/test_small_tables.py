"""Tables of a row a group are sent to the points; no group's points are dealt to one task."""

import math

import numpy as np
import pytest

from plumbline.operators import components, detect, planes
from plumbline.operators import points as pts
from plumbline.plans import queries, scene

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_not_dealt_by_their_group(spark):
    p = scene.points(spark, SF)
    fits = planes.fit(p, "facade_id")
    for df in (planes.with_plane(p, fits, "facade_id"), planes.with_uv(p, scene.facades(spark), "facade_id"), components.grid_cells(planes.with_uv(p, fits, "facade_id"), 1.0, "facade_id")):
        assert "SortMergeJoin" not in plan(df) and "BroadcastHashJoin" in plan(df)
    assert "SortMergeJoin" not in plan(pts.voxel_downsample(p, 0.5, "facade_id"))


@pytest.mark.parametrize("name", ["label_colors", "highlight_colors"])
def test_colours_need_no_shuffle(spark, name):
    assert "SortMergeJoin" not in plan(queries.QUERIES[name](spark, SF))


def test_axes_are_found_once_a_plane(spark):
    p = scene.points(spark, SF)
    assert "SQRT" not in plan(planes.with_uv(p.select("facade_id", "point_id", "x", "y", "z"), scene.facades(spark), "facade_id")).upper()


def test_hulls_meet_as_corners(spark):
    """The hull of a ring of a thousand corners, and no row a strip and u on the way."""
    turn = np.linspace(0, 2 * math.pi, 1000, endpoint=False)
    ring = [(1, float(3 * math.cos(t)), float(3 * math.sin(t)), 0.0) for t in turn]
    inner = [(1, float(x), float(y), 0.0) for x, y in np.random.default_rng(3).uniform(-2, 2, (5000, 2))]
    df = spark.createDataFrame(ring + inner + [(2, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], "k int, x double, y double, z double").repartition(3)
    flat = spark.createDataFrame([(k, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0) for k in (1, 2)], "k int, na double, nb double, nc double, nd double, cx double, cy double, cz double")
    found = detect.hull_area(df, flat, "k")
    assert "MapInPandas" in plan(found)
    got = {r.k: (r.area_hull, r.hull_points) for r in found.collect()}
    assert got[1][0] == pytest.approx(9 * 500 * math.sin(2 * math.pi / 1000), rel=1e-12) and got[1][1] == 1000
    assert got[2] == (0.0, 2)
