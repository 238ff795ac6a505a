"""Wall detection and region segmentation: bounded driver loops over DataFrames.

Each round asks Spark for a few numbers (the best plane, group sizes) and stores what is left; clouds never reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import colours
from plumbline.functions import geometry as g
from plumbline.operators import components, planes
from plumbline.operators.storage import release, stored

P = ("x", "y", "z")
N = ("nx", "ny", "nz")


@dataclass
class Detection:
    """Parameters; zero counts as not given for those that default to a rule."""

    voxel: float = 0.05
    least_area: float = 5.0
    tolerance: float = 0.0
    least_share: float = 0.003
    degrees: float = 5.0
    least_cluster: int = 200
    uv_grid: float = 0.0
    least_cells_share: float = 0.015
    eps: float = 0.0
    rounds: int = 40
    trials: int = 500
    #: Where no grid is given, take it from the spacing of each round's points: this many times the mean (0: from the voxel).
    adaptive: float = 0.0

    def resolved(self, n: int) -> dict:
        least = max(100, int(self.least_share * n))
        cluster = max(self.least_cluster, least)
        return {
            "tolerance": self.tolerance or max(1.5 * self.voxel, 0.03),
            "least": least,
            "cluster": cluster,
            "grid": self.uv_grid or max(2 * self.voxel, 0.1),
            "cells": max(2, int(self.least_cells_share * cluster)),
            "eps": self.eps or max(6 * self.voxel, 0.35),
            "core": max(12, cluster // 8),
        }


def _refined(points: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(points near their group's plane, planes of those): fit, drop beyond 1.8 tolerances, fit again; by ``group``."""
    near = planes.with_plane(points, planes.fit(points, "group"), "group").where(g.distance(P, planes.PLANE) <= 1.8 * tolerance)
    near = near.drop(*planes.PLANE, "cx", "cy", "cz")
    return near, planes.fit(near, "group")


def detect(points: DataFrame, options: Detection | None = None) -> tuple[DataFrame, DataFrame]:
    """(facades, membership) of one cloud with point_id, x, y, z and normals.

    What a round takes is told by its plane and grid cells, or by its plane alone, so rounds deal no points by their ids. Each round draws hash-seeded planes, takes the one with most points near it, narrows to points whose normals agree and that lie within the
    tolerance, and splits them into grid components in the plane. Components that are large enough become facades; their points are
    taken out. If a round takes nothing, density clusters of the plane's points are tried, and all its seeds are taken out.
    Facades are ranked: vertical ones first, then by points; numbered from 0.
    """
    o = options or Detection()
    spark = points.sparkSession
    left = stored(points.select("point_id", *P, *N))
    n = left.count()
    r = o.resolved(n)
    tol, found, members = r["tolerance"], [], []
    for turn in range(o.rounds):
        n = left.count()
        if n < r["least"]:
            break
        drawn = planes.hypotheses(left, o.trials, seed=turn + 1)
        if not drawn:
            break
        best, inliers = planes.ransac(left, drawn, tol)
        if inliers < r["least"]:
            break
        plane = drawn[best]
        close = F.coalesce(g.distance(P, plane) <= tol, F.lit(False))
        agree = F.coalesce(planes.candidates(left, plane, 1.5 * tol, o.degrees), F.lit(False))
        wide, narrow = left.agg(F.count_if(agree), F.count_if(agree & close)).first()
        chosen = close if wide < r["least"] else agree & close if narrow >= r["least"] else agree
        u, v = g.uv(P, [F.lit(0.0)] * 3, g.plane_axes([F.lit(x) for x in plane[:3]]))
        placed = left.withColumns({"u": u, "v": v, "cloud": F.lit(0)})
        flat = stored(placed.where(chosen).select("point_id", *P, "u", "v", "cloud"))
        grid = r["grid"]
        if o.adaptive and not o.uv_grid:
            grid = components.adaptive_size(flat.select("point_id", F.col("u").alias("x"), F.col("v").alias("y"), F.lit(0.0).alias("z")), grid, o.adaptive)
        cells = stored(components.grid_components(flat, grid, r["cells"], "cloud").select("i", "j", F.col("component").alias("group")))
        grouped = components.grid_cells(flat, grid, "cloud").join(cells, ["i", "j"])
        before, gone = left, _accept(grouped, r, tol, o, turn, found, members)
        if gone is not None:
            # cells tell which of the plane's points are taken, so no ids are dealt
            own = components.placed_cells(placed, flat, grid, "cloud")
            at = {c: F.when(chosen, F.col(c)) for c in "ij"}
            taken = stored(cells.join(gone, "group").select("i", "j"))
            left = stored(own.withColumns(at).join(taken, ["i", "j"], "left_anti").select(*left.columns))
        else:
            clusters = components.clustered(flat.select("point_id", *P), r["eps"], r["core"])
            left = left.where(~close)
            if clusters is not None:
                grouped = stored(clusters.withColumnRenamed("cluster", "group"))
                gone = _accept(grouped, r, tol, o, turn, found, members)
                if gone is not None:
                    left = _without(left, grouped.where(~close).join(gone, "group"))
                release(grouped)
            left = stored(left)
        release(before, flat)
    if not found:
        empty = _records(points.where("false").withColumn("group", F.lit(0))).withColumn("round", F.lit(0))
        return ranked(empty), spark.createDataFrame([], "facade_id int, point_id long")
    facades = ranked(planes.union_all(found))
    membership = planes.union_all(members).join(facades.select("round", "group", "facade_id"), ["round", "group"]).select("facade_id", "point_id")
    return facades.drop("round", "group"), membership


def _records(near: DataFrame) -> DataFrame:
    """Records with ``area``: the convex hull's, or the bounding box's where there is no hull."""
    fits = planes.fit(near, "group")
    hulls = hull_area(near, fits, "group").select("group", F.when(F.col("hull_points") >= 3, F.col("area_hull")).alias("_hull"))
    return planes.records(near, fits, "group").join(hulls, "group", "left").withColumn("area", F.coalesce("_hull", "area_bbox")).drop("_hull")


def _accept(grouped: DataFrame, r: dict, tol: float, o: Detection, turn: int, found: list, members: list) -> DataFrame | None:
    """Keeps the large enough groups as facades; gives all groups with enough points, those too small in area included."""
    sizes = stored(grouped.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") >= r["cluster"]).select("group"))
    if sizes.isEmpty():
        return None
    near, _ = _refined(grouped.join(sizes, "group").select("group", "point_id", *P), tol)
    near = stored(near)
    kept = stored(_records(near).where((F.col("area") >= o.least_area) & (F.col("point_count") >= r["least"])).withColumn("round", F.lit(turn)))
    if kept.isEmpty():
        release(near)
    else:
        found.append(kept)
        members.append(near.join(kept.select("group"), "group", "left_semi").select(F.lit(turn).alias("round"), "group", "point_id"))
    return sizes


def _without(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points but those with these ids, which are few: where there are none, nothing is joined."""
    ids = stored(ids.select("point_id").distinct())
    return points if ids.isEmpty() else points.join(ids, "point_id", "left_anti").select(*points.columns)


def ranked(facades: DataFrame) -> DataFrame:
    """facade_id from 0: vertical first, then most points; the rest of the order settles ties."""
    tie = [c for c in ("round", "group", "facade") if c in facades.columns]
    order = Window.orderBy(F.when(F.col("type") == "vertical_facade", 0).otherwise(1), F.desc("point_count"), *tie)  # one row a facade
    return facades.withColumn("facade_id", F.row_number().over(order) - 1)


def dense_labels(points: DataFrame, membership: DataFrame) -> DataFrame:
    """Every point with its facade, -1 for none; a point of several facades has the last."""
    last = membership.groupBy("point_id").agg(F.max("facade_id").alias("facade_id"))
    return points.join(last, "point_id", "left").withColumn("facade_id", F.coalesce("facade_id", F.lit(-1)))


def response(points: DataFrame, facades: DataFrame, labels: DataFrame) -> DataFrame:
    """What a viewer shows of a detection: every point of the display cloud with facade_id, normal (zero where it has none) and display colour.

    ``labels`` (point_id, facade_id) must name every point once, else an error tells both counts.
    """
    paired = points.select("point_id").join(labels.select("point_id", F.lit(1).alias("_l")), "point_id", "full")
    all_, named, twice = points.count(), labels.count(), paired.where("_l is null").count()
    if all_ != named or twice:
        raise ValueError(f"{named} labels for {all_} points, {twice} points without one")
    kinds = facades.select("facade_id", F.col("type").alias("_type"))  # one row a facade
    rows = points.drop("facade_id").join(labels.select("point_id", "facade_id"), "point_id").join(kinds, "facade_id", "left")
    shown = colours.by_type(F.col("_type"), colours.dimmed(colours.channels(), 0.35))
    normal = [F.coalesce(c, F.lit(0.0)) if c in points.columns else F.lit(0.0) for c in N]
    columns = dict(zip((*P, *N, *"rgb"), (*map(F.col, P), *normal, *shown), strict=True))
    return rows.select("point_id", "facade_id", *[c.cast("float").alias(n) for n, c in columns.items()])


def segment(points: DataFrame, selected: DataFrame, options: Detection | None = None, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """(segments, membership) of the selected points (ids may repeat or be unknown), for a hand-picked region.

    Each round takes the plane with most points near it, points within 1.8 tolerances whose normals agree (or the plane's own if those are too few),
    and splits them into density clusters, largest first; a cluster is refitted and keeps its points within two tolerances. The plane's
    points and the whole clusters of segments are taken out. Segments are numbered in the order found, clusters of a round from the
    largest on. Fewer points than a segment needs, before or after unknown ids are dropped, give no segments.
    """
    o = options or Detection(degrees=18.0, least_cluster=80, least_area=0.0, trials=800)
    spark, least = points.sparkSession, o.least_cluster
    tol, eps = o.tolerance or max(1.5 * o.voxel, 0.03), o.eps or max(5 * o.voxel, 0.25)
    left = stored(points.select("point_id", *P, *N).join(selected.select("point_id").distinct(), "point_id", "left_semi"))
    found, members = [], []
    for turn in range(most):
        if left.count() < least:
            break
        drawn = planes.hypotheses(left, o.trials, seed=turn + 1)
        if not drawn:
            break
        best, inliers = planes.ransac(left, drawn, tol)
        if inliers < least:
            break
        plane = drawn[best]
        close = F.coalesce(g.distance(P, plane) <= tol, F.lit(False))
        near = stored(left.where(planes.candidates(left, plane, 1.8 * tol, o.degrees)))
        if near.count() < least:
            release(near)
            near = stored(left.where(close))
        clusters = components.clustered(near.select("point_id", *P), eps, max(8, least // 10))
        # without any cluster all candidates are one
        if clusters is None or (clusters := stored(clusters)).isEmpty():
            clusters = near.select("point_id", *P, F.lit(0).cast(near.schema["point_id"].dataType).alias("cluster"))
        grouped = clusters.select(F.col("cluster").alias("group"), "point_id", *P)
        large = stored(grouped.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") >= least))
        grouped = grouped.join(large.select("group"), "group")
        kept = planes.with_plane(grouped, planes.fit(grouped, "group"), "group").where(g.distance(P, planes.PLANE) <= 2.0 * tol).select("group", "point_id", *P)
        enough = stored(kept.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("group"))
        before, left = left, left.where(~close)
        if not enough.isEmpty():
            kept = stored(kept.join(enough, "group"))
            found.append(stored(_records(kept).join(large.withColumnRenamed("_n", "cluster_size"), "group").withColumn("round", F.lit(turn))))
            members.append(kept.select(F.lit(turn).alias("round"), "group", "point_id"))
            left = _without(left, grouped.where(~close).join(enough, "group"))
        left = stored(left)
        release(before, near)
    if not found:
        empty = _records(points.where("false").withColumn("group", F.lit(0))).withColumns({"round": F.lit(0), "cluster_size": F.lit(0).cast("long")})
        return ranked(empty).drop("round", "group"), spark.createDataFrame([], "facade_id int, point_id long")
    order = Window.orderBy("round", F.desc("cluster_size"), "group")  # one row a segment
    segments = planes.union_all(found).withColumn("facade_id", F.row_number().over(order) - 1).where(F.col("facade_id") < most)
    membership = planes.union_all(members).join(segments.select("round", "group", "facade_id"), ["round", "group"]).select("facade_id", "point_id")
    return segments.drop("round", "group"), membership


def segment_region(points: DataFrame, selected: DataFrame, options: Detection | None = None, most: int = 30) -> tuple[DataFrame, DataFrame, str]:
    """(records, labels, message) of a hand-picked region: ``segment_records``, a label for every point of the cloud (-1 for none), and what
    a viewer tells: how many planes were found, or why none were looked for."""
    least = (options or Detection(least_cluster=80)).least_cluster
    message = ""
    if selected.limit(least).count() < least:
        message = "too few points selected"
    elif points.select("point_id").join(selected.select("point_id").distinct(), "point_id", "left_semi").limit(least).count() < least:
        message = "too few valid points selected"
    segments, members = segment(points, selected, options, most)
    records = segment_records(points, segments, members)
    return records, dense_labels(points.select("point_id"), members), message or f"{segments.count()} local planes found"


def segment_records(points: DataFrame, segments: DataFrame, members: DataFrame) -> DataFrame:
    """The segments with width, height, hull area and their colour."""
    own = members.join(points.select("point_id", *P), "point_id")
    spans = dimensions(own, segments, "facade_id").select("facade_id", "width", "height")
    turn = F.pmod("facade_id", F.lit(len(colours.BY_SEGMENT)))
    shown = colours.chosen([(turn == i, c) for i, c in enumerate(colours.BY_SEGMENT)], [F.lit(0.0)] * 3)
    return segments.join(spans, "facade_id").withColumn("color", F.array(*shown))


def dimensions(points: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    """Width, height and bounding area of each segment; a vertical one takes its height from z."""
    flat = planes.with_uv(points, fitted, key).select(key, "u", "v", "z", g.plane_type("nc").alias("type"))
    spans = flat.groupBy(key).agg(F.first("type").alias("type"), *[(F.max(c) - F.min(c)).alias(f"_{c}") for c in "uvz"])
    height = F.when(F.col("type") == "vertical_facade", F.col("_z")).otherwise(F.col("_v"))
    return spans.select(key, "type", F.col("_u").alias("width"), height.alias("height"), (F.col("_u") * height).alias("area"))


def hull_area(points: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    """Area of each group's convex hull in its plane (monotone chain; Andrew, 1979).

    Every task keeps the hull of the points it has seen of each group, so a group's points are not gathered: what meets in a task
    are the corners of the tasks' hulls.
    """
    import numpy as np
    import pandas as pd

    flat = planes.with_uv(points, fitted, key).select(key, "u", "v")

    def chain(xs: np.ndarray, ys: np.ndarray) -> list[tuple[float, float]]:
        order = np.lexsort((ys, xs))
        pts = list(dict.fromkeys(zip(xs[order].tolist(), ys[order].tolist(), strict=True)))
        if len(pts) < 3:
            return pts
        out = []
        for seq in (pts, pts[::-1]):
            side: list[tuple[float, float]] = []
            for p in seq:
                while len(side) >= 2 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) <= 0:
                    side.pop()
                side.append(p)
            out += side[:-1]
        return out

    def outside(xs: np.ndarray, ys: np.ndarray, hull: list[tuple[float, float]]) -> np.ndarray:
        """Points that are not clearly inside the hull, which runs counter-clockwise."""
        inside = np.full(len(xs), len(hull) >= 3)
        for (ax, ay), (bx, by) in zip(hull, [*hull[1:], *hull[:1]], strict=True):
            along, across = (bx - ax) * (ys - ay), (by - ay) * (xs - ax)
            inside &= along - across > 1e-9 * (np.abs(along) + np.abs(across))
        return ~inside

    def corners(frames):
        hulls: dict = {}
        for frame in frames:
            for name, part in frame.groupby(key, dropna=False, sort=False):
                xs, ys = part["u"].to_numpy(float), part["v"].to_numpy(float)
                finite = np.isfinite(xs) & np.isfinite(ys)
                xs, ys, hull = xs[finite], ys[finite], hulls.get(name, [])
                new = outside(xs, ys, hull)
                old = np.array(hull, float).reshape(-1, 2)
                hulls[name] = chain(np.concatenate((old[:, 0], xs[new])), np.concatenate((old[:, 1], ys[new])))
        for name, h in hulls.items():
            yield pd.DataFrame({key: [name] * max(1, len(h)), "u": [p[0] for p in h] or [np.nan], "v": [p[1] for p in h] or [np.nan]})

    def area(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.dropna(subset=["u"])
        h = chain(own["u"].to_numpy(float), own["v"].to_numpy(float))
        twice = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(h, [*h[1:], *h[:1]], strict=True))
        return pd.DataFrame({key: [frame[key].iloc[0]], "area_hull": [abs(twice) / 2], "hull_points": [len(h)]})

    kind = points.schema[key].dataType.simpleString()
    return flat.where(F.col(key).isNotNull()).mapInPandas(corners, f"{key} {kind}, u double, v double").groupBy(key).applyInPandas(area, f"{key} {kind}, area_hull double, hull_points long")
