"""Every window of an interval is looked at, and points on a window's bound are in it."""

from pyspark.sql import functions as F

from plumbline.operators import planes, quality
from plumbline.operators.storage import stored
from plumbline.plans import oracles


def wall(spark, width, height, gap):
    rows = [(0, 0, i * 1000 + k, i * gap, 0.0, k * gap) for i in range(round(width / gap) + 1) for k in range(round(height / gap) + 1)]
    return stored(spark.createDataFrame(rows, "facade_id int, interval_id int, point_id long, x double, y double, z double"))


def test_more_than_6000_windows_are_all_looked_at(spark):
    points = wall(spark, 6.0, 6.0, 0.1)
    own = stored(planes.fit(points, "facade_id", "interval_id"))
    flat, span = quality._spans(points, own, quality.RULER, quality.STEP)
    s = span.first()
    got = {(r.ku, r.kv) for r in quality.windows(points, own).select("ku", "kv").collect()}
    assert s.nu * s.nv > 6000 and got == {(i, k) for i in range(s.nu) for k in range(s.nv)}


def test_no_sql_of_the_quality_queries_thins_windows():
    assert not any("6000" in sql for name, sql in oracles.SQL.items() if name.startswith("quality"))


def test_points_on_a_window_s_bound_are_in_it_whatever_the_plane_s_last_bits(spark):
    """Every point of a grid of one step lies on bounds; far from the origin its differences are rounded."""
    points = wall(spark, 3.0, 3.0, 0.05).withColumns({p: F.col(p) + a for p, a in (("x", 1000.1), ("z", 77.7))}).transform(stored)
    own = stored(planes.fit(points, "facade_id", "interval_id", exact=True))
    plain = {r.points for r in quality.windows(points, own).collect()}
    assert plain != {41 * 41}
    assert [r.points for r in quality.windows(points, own, digits=6).collect()] == [41 * 41] * 21 * 21


def test_the_exact_centre_does_not_follow_the_order_of_rows(spark):
    rows = [(0, i, 1e5 + 0.1 * i, 0.001 * (i % 7), -1.0 / (i + 1)) for i in range(3000)]
    schema = "facade_id int, point_id long, x double, y double, z double"
    found = {tuple(planes.fit(spark.createDataFrame(r, schema).coalesce(1), "facade_id", exact=True).select("cx", "cy", "cz").first()) for r in (rows, rows[::-1], rows[1::2] + rows[::2])}
    assert len(found) == 1
    assert abs(found.pop()[0] - (1e5 + 0.1 * 2999 / 2)) < 1e-9


def test_intervals_begin_at_whole_micrometres(spark):
    """A point exactly 0.3 m above the lowest opens the next interval."""
    points = wall(spark, 1.0, 0.9, 0.1).withColumn("z", F.col("z") + 77.7).transform(stored)
    walls = stored(planes.fit(points, "facade_id", exact=True))
    kept, own = quality.intervals(points.drop("interval_id"), walls, 0.3, 1, digits=6)
    assert {r.interval_id: r.n for r in own.select("interval_id", "n").collect()} == {0: 33, 1: 33, 2: 44}
