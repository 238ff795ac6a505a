"""Walls seen in photos: regions, snapping, picking and deviation heatmaps. A pose is a dict (see ``functions.geometry.project``)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import colours
from plumbline.functions import geometry as g
from plumbline.operators import planes
from plumbline.operators.points import every_kth, numbered
from plumbline.operators.quantiles import quantiles
from plumbline.operators.storage import stored

P = ("x", "y", "z")


def camera_centre(pose: dict) -> list[float]:
    r, t = np.array(pose["rotation"], float), np.array(pose["translation"], float)
    return (-r.T @ t).tolist()


def pixel_ray(pixel, pose: dict) -> tuple[list[float], list[float]]:
    """Origin and unit direction in the world of a pixel's ray; distortion is undone by fixed-point steps."""
    k = pose["camera_matrix"]
    k1, k2, p1, p2, k3 = g.five(pose.get("distortion"))
    xd, yd = (pixel[0] - k[0][2]) / k[0][0], (pixel[1] - k[1][2]) / k[1][1]
    x, y = xd, yd
    for _ in range(50):
        rr = x * x + y * y
        radial = 1 + rr * (k1 + rr * (k2 + rr * k3))
        x, y = (xd - 2 * p1 * x * y - p2 * (rr + 2 * x * x)) / radial, (yd - p1 * (rr + 2 * y * y) - 2 * p2 * x * y) / radial
    d = np.array(pose["rotation"], float).T @ np.array([x, y, 1.0])
    return camera_centre(pose), (d / np.linalg.norm(d)).tolist()


def project_points(points: DataFrame, pose: dict) -> DataFrame:
    # generators, so that pixels use the place before the camera, and filters above the pixels, instead of copies of their expressions
    xn, yn, depth = g.seen_from(P, pose)
    before = points.select("*", F.inline(F.array(F.struct(xn.alias("_xn"), yn.alias("_yn"), depth.alias("_depth")))))
    px, py = g.bent(F.col("_xn"), F.col("_yn"), pose)
    return before.select(*points.columns, F.inline(F.array(F.struct(px.alias("px"), py.alias("py"), F.col("_depth").alias("depth")))))


def in_photo_quadrilateral(points: DataFrame, pose: dict, corners) -> DataFrame:
    """Points before the camera whose pixels lie in the quadrilateral."""
    shown = project_points(points, pose)
    return shown.where((F.col("depth") > 1e-9) & g.inside_quadrilateral(F.col("px"), F.col("py"), corners))


def facade_in_quadrilateral(points: DataFrame, pose: dict, corners, least: int = 3) -> DataFrame:
    """The facade with most points in the photo's quadrilateral; ties go to the larger covered share, then the lower id."""
    inside = F.when((F.col("depth") > 1e-9) & g.inside_quadrilateral(F.col("px"), F.col("py"), corners), 1)
    counts = project_points(points, pose).groupBy("facade_id").agg(F.count(inside).alias("inside"), F.count("*").alias("points"))
    found = counts.where(F.col("inside") >= least).withColumn("coverage", F.col("inside") / F.col("points"))
    return found.orderBy(F.desc("inside"), F.desc("coverage"), "facade_id").limit(1)


def largest_visible_facade(points: DataFrame, facades: DataFrame, pose: dict, width: int, height: int, *, sample: int = 5000, least: int = 3, least_share: float = 0.02) -> DataFrame:
    """The facade with the largest area times visible share, over about ``sample`` points of each (a stride over ids' order)."""
    placed = numbered(points.select("facade_id", "point_id", *P), "facade_id", "point_id", name="_i")
    sizes = placed.groupBy("facade_id").agg(F.count("*").alias("_all"), F.min("_i").alias("_first"))
    sampled = placed.join(sizes, "facade_id").where((F.col("_i") - F.col("_first")) % F.greatest(F.lit(1), F.floor(F.col("_all") / sample)) == 0)
    shown = (F.col("depth") > 1e-9) & (F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)
    counts = project_points(sampled, pose).groupBy("facade_id").agg(F.count(F.when(shown, 1)).alias("visible"), F.count("*").alias("sampled"))
    scored = counts.join(facades.select("facade_id", "area"), "facade_id").withColumn("share", F.col("visible") / F.col("sampled")).withColumn("score", F.col("area") * F.col("share"))
    return scored.where((F.col("visible") >= least) & (F.col("share") >= least_share)).orderBy(F.desc("score"), "facade_id").limit(1)


def snap(queries: DataFrame, facades: DataFrame, most: float = 4.0) -> DataFrame:
    """Each query point (query_id, x, y, z) on its nearest facade plane: those within ``most`` first, ties to the larger area, then the lower id.

    Facades are few (one row a wall): they travel as one array and are compared row by row, without a join.
    """
    rows = [tuple(r) for r in facades.select("facade_id", *planes.PLANE, "area").collect()]
    options = F.array(*[F.struct((g.distance(P, r[1:5]) > most).alias("far"), g.distance(P, r[1:5]).alias("dist"), F.lit(-float(r[5])).alias("area"), F.lit(r[0]).alias("facade_id"), *[F.lit(float(c)).alias(n) for n, c in zip(planes.PLANE, r[1:5], strict=True)]) for r in rows])
    best = queries.withColumn("_b", F.array_min(options))
    on = g.foot(P, [F.col(f"_b.{n}") for n in planes.PLANE])
    return best.select("query_id", F.col("_b.facade_id").alias("facade_id"), F.col("_b.dist").alias("dist"), *[c.alias(f"snapped_{p}") for c, p in zip(on, P, strict=True)])


def scaled(shown: DataFrame, scale: float) -> DataFrame:
    """Projected points in the pixels of a screen with another density."""
    return shown if scale == 1.0 else shown.withColumns({c: F.col(c) * scale for c in ("px", "py")})


def nearest_pick(points: DataFrame, pose: dict, x: float, y: float, radius: float, *, scale: float = 1.0) -> DataFrame:
    """The point picked at a pixel: nearest pixel within the radius, else the one nearest in pixels. ``points`` may be several clouds in one
    table, told apart by a column ``cloud``; ties go to the first cloud, then the lower id. ``scale`` is the screen's pixels a photo pixel."""
    shown = scaled(project_points(points, pose).where("depth > 1e-9"), scale)
    off = F.sqrt((F.col("px") - x) * (F.col("px") - x) + (F.col("py") - y) * (F.col("py") - y))
    ranked = shown.withColumn("off", off).withColumn("outside", (F.col("off") > radius).cast("int"))
    return ranked.orderBy("outside", "off", *(["cloud"] if "cloud" in points.columns else []), "point_id").limit(1)


def select_rectangle(points: DataFrame, pose: dict, low, high, step: int = 1, *, order: tuple[str, ...] = (), scale: float = 1.0) -> DataFrame:
    """Ids of the display sample's points whose pixels lie in a screen rectangle (closed). The sample is every step-th row in the
    given order, or, without one, the points whose id is a multiple of the step."""
    sample = every_kth(points, step, *order) if order else points.where(F.col("point_id") % step == 0)
    shown = scaled(project_points(sample, pose), scale)
    return shown.where((F.col("depth") > 1e-9) & F.col("px").between(low[0], high[0]) & F.col("py").between(low[1], high[1]))


def refine_corners(points: DataFrame, pose: dict, pixels, corners, *, ball: float = 3.0, most: float = 120.0) -> DataFrame:
    """Each of four corners moved to the wall point of least reprojection error, among points within a ball of the first guess or
    near the pixel's ray; unmoved if the error is above ``most`` pixels.

    One pass with one min_by for each corner; no join.
    """
    aggregates, centre = [], camera_centre(pose)
    for i, (pixel, corner) in enumerate(zip(pixels, corners, strict=True)):
        d2 = sum(((F.col(p) - float(c)) * (F.col(p) - float(c)) for p, c in zip(P, corner, strict=True)), F.lit(0.0))
        origin, ray = centre, pixel_ray(pixel, pose)[1]
        rel = [F.col(p) - o for p, o in zip(P, origin, strict=True)]
        along = g.dot(rel, ray)
        off2 = g.dot(rel, rel) - along * along
        error = F.sqrt((F.col("px") - float(pixel[0])) * (F.col("px") - float(pixel[0])) + (F.col("py") - float(pixel[1])) * (F.col("py") - float(pixel[1])))
        near = (F.col("depth") > 1e-9) & ((d2 <= ball * ball) | (off2 <= ball * ball / 4))
        aggregates.append(F.min(F.when(near & (error <= most), F.struct(error.alias("error"), "point_id", *P))).alias(f"c{i}"))
    row = project_points(points, pose).agg(*aggregates)
    parts = [F.struct(F.lit(i).alias("corner"), F.col(f"c{i}.point_id").alias("point_id"), F.col(f"c{i}.error").alias("error"), *[F.coalesce(F.col(f"c{i}.{p}"), F.lit(float(corners[i][j]))).alias(p) for j, p in enumerate(P)]) for i in range(len(corners))]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def quadrilateral_corners(pixels, pose: dict, plane) -> list[list[float]] | None:
    """Where four pixels' rays meet a plane; None if one does not."""
    out = []
    for pixel in pixels:
        o, d = map(np.array, pixel_ray(pixel, pose))
        slope = float(d @ np.array(plane[:3]))
        if abs(slope) < 1e-9 or (t := -(float(o @ np.array(plane[:3])) + plane[3]) / slope) <= 0:
            return None
        out.append((o + t * d).tolist())
    return out


def facing(plane, reference, camera) -> list[float]:
    """The plane with its normal towards the camera."""
    toward = sum(n * (c - r) for n, c, r in zip(plane[:3], camera, reference, strict=True))
    return [-x for x in plane] if toward < 0 else list(plane)


def in_3d_quadrilateral(points: DataFrame, plane, corners) -> DataFrame:
    """Points whose feet on the plane lie in the quadrilateral of the corners' feet."""
    lit = [[F.lit(float(c)) for c in corner] for corner in corners]
    axes = g.plane_axes([F.lit(float(n)) for n in plane[:3]])
    n = np.array(plane[:3], float)
    u, v = _axes(n)
    at = np.array(corners, float)
    flat = np.column_stack(((at - at[0]) @ u, (at - at[0]) @ v)).tolist()
    pu, pv = g.uv(P, lit[0], axes)
    return points.where(g.inside_quadrilateral(pu, pv, flat))


def _axes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same axes as ``functions.geometry.plane_axes``, for one plane on the driver."""
    if abs(n[2]) < 0.45:
        flat = float(np.hypot(n[0], n[1]))
        return (np.array([-n[1] / flat, n[0] / flat, 0.0]) if flat >= 1e-8 else np.array([1.0, 0.0, 0.0])), np.array([0.0, 0.0, 1.0])
    u = np.cross(n, [0.0, 0.0, 1.0] if abs(n[2]) < 0.9 else [1.0, 0.0, 0.0])
    u /= np.linalg.norm(u)
    return u, np.cross(n, u)


def heatmap(points: DataFrame, plane, *, cell: float = 0.5, least: int = 3, percentile: float = 0.98, floor: float = 0.004, most: int = 200) -> DataFrame:
    """Deviation cells of a wall: i, j, bounds, median signed distance and colour.

    The cell grows so that a side has at most ``most`` bins; bins are clipped to the extent, and cells of no width vanish. Colours saturate at
    the percentile of the cells' absolute values, at least ``floor``.
    """
    axes = g.plane_axes([F.lit(float(n)) for n in plane[:3]])
    u, v = g.uv(P, [F.lit(0.0)] * 3, axes)
    flat = points.select(u.alias("u"), v.alias("v"), g.signed_distance(P, plane).alias("s"))
    b = flat.agg(*[f(a).alias(f"{a}{n}") for a in "uv" for n, f in ((0, F.min), (1, F.max))]).first()
    if b.u0 is None:
        return flat.select(F.lit(0).alias("i"), F.lit(0).alias("j"), *[F.lit(0.0).alias(n) for n in ("u0", "u1", "v0", "v1", "value", "limit", "r", "g", "b")], F.lit(0).alias("points")).where("false")
    size = max(cell, (b.u1 - b.u0) / most, (b.v1 - b.v0) / most)
    bins = {a: max(1, int(np.ceil((hi - lo) / size - 1e-12))) for a, lo, hi in (("u", b.u0, b.u1), ("v", b.v0, b.v1))}
    index = {a: F.least(F.lit(bins[a] - 1), F.floor((F.col(a) - lo) / size).cast("int")) for a, lo in (("u", b.u0), ("v", b.v0))}
    placed = stored(flat.select(index["u"].alias("i"), index["v"].alias("j"), "s"))
    cells = quantiles(placed, "s", 0.5, "i", "j").select("i", "j", F.col("quantile").alias("value"), F.col("n").alias("points")).where(F.col("points") >= least)
    edges = {f"{a}{n}": F.least(F.lit(float(hi)), float(lo) + (F.col(k) + n) * size) for a, k, lo, hi in (("u", "i", b.u0, b.u1), ("v", "j", b.v0, b.v1)) for n in (0, 1)}
    cells = cells.withColumns(edges).where("u1 > u0 AND v1 > v0")
    limit = cells.agg(F.percentile(F.abs("value"), percentile)).first()[0]
    cells = cells.withColumn("limit", F.lit(max(floor, limit or 0.0)))
    return cells.withColumns(dict(zip("rgb", colours.heat(F.col("value"), F.col("limit")), strict=True)))


def heatmap_mesh(cells: DataFrame) -> DataFrame:
    """Two triangles a cell, corners counter-clockwise."""
    corner = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    q = [corner("u0", "v0"), corner("u1", "v0"), corner("u1", "v1"), corner("u0", "v1")]
    triangles = F.array(F.struct(F.lit(0).alias("part"), F.array(q[0], q[1], q[2]).alias("corners")), F.struct(F.lit(1).alias("part"), F.array(q[0], q[2], q[3]).alias("corners")))
    return cells.select("i", "j", F.explode(triangles).alias("t"), "r", "g", "b").select("i", "j", "t.part", "t.corners", "r", "g", "b")


@dataclass
class Region:
    """The part of a wall that a photo shows: the wall, its plane turned to the camera, the four corners in space (None for a whole wall), its points and its area."""

    facade_id: int
    plane: list[float]
    corners_3d: list[list[float]] | None
    points: DataFrame
    area: float
    coverage: float | None = None
    visible: float | None = None


def photo_region(points: DataFrame, facades: DataFrame, pose: dict, corners, *, corners_3d=None, refine: bool = True) -> Region:
    """The wall with most points in a photo's quadrilateral and its points there. Corners in space may be given (4 x 3); else they are where the pixels' rays meet the
    wall, moved to wall points with ``refine``. ``points`` have facade_id; ``facades`` plane, centre and area."""
    chosen = facade_in_quadrilateral(points, pose, corners).first()
    if chosen is None:
        raise ValueError("no wall has three points in the quadrilateral")
    if corners_3d is not None and (len(corners_3d) != 4 or any(len(c) != 3 for c in corners_3d)):
        raise ValueError("four corners with three coordinates each are needed")
    row = facades.where(F.col("facade_id") == chosen.facade_id).first()
    plane = facing(g.unit_plane([row[c] for c in planes.PLANE]), [row[c] for c in ("cx", "cy", "cz")], camera_centre(pose))
    own = points.where(F.col("facade_id") == chosen.facade_id)
    at = corners_3d or quadrilateral_corners(corners, pose, plane)
    if at is None:
        raise ValueError("a corner's ray does not meet the wall")
    if not corners_3d and refine:
        at = [[r.x, r.y, r.z] for r in refine_corners(own, pose, corners, at).orderBy("corner").collect()]
    region = in_3d_quadrilateral(own, plane, at)
    if region.limit(3).count() < 3:
        raise ValueError("the region has under three points")
    return Region(chosen.facade_id, plane, [list(map(float, c)) for c in at], region, float(row["area"]), coverage=chosen.coverage)


def visible_wall(points: DataFrame, facades: DataFrame, pose: dict, width: int, height: int) -> Region:
    """The whole wall with the largest visible area in a photo."""
    chosen = largest_visible_facade(points, facades, pose, width, height).first()
    if chosen is None:
        raise ValueError("no wall is visible in the photo")
    row = facades.where(F.col("facade_id") == chosen.facade_id).first()
    plane = facing(g.unit_plane([row[c] for c in planes.PLANE]), [row[c] for c in ("cx", "cy", "cz")], camera_centre(pose))
    return Region(chosen.facade_id, plane, None, points.where(F.col("facade_id") == chosen.facade_id), float(row["area"]), visible=chosen.share)


def photo_heatmap(points: DataFrame, facades: DataFrame, pose: dict, corners=None, *, corners_3d=None, cell: float = 0.5, size: tuple[int, int] | None = None) -> DataFrame:
    """The heatmap of the part of a wall that a photo quadrilateral shows, or, without one, of the wall most of which a photo of that size (width, height) shows."""
    if corners is None and size is None:
        raise ValueError("a quadrilateral or the photo's size is needed")
    region = visible_wall(points, facades, pose, *size) if corners is None else photo_region(points, facades, pose, corners, corners_3d=corners_3d)
    return heatmap(region.points, region.plane, cell=cell)


def highlight(points: DataFrame, facade_id: int, factor: float = 0.22) -> DataFrame:
    """Colours that show one facade: it in green, other facades dim by type, the rest dark."""
    dim = colours.dimmed(colours.channels(), factor)
    others = colours.by_type(F.coalesce("type", F.lit("")), dim, dim=True)
    picked = colours.chosen([(F.col("facade_id") == facade_id, colours.HIGHLIGHT)], [F.when(F.col("facade_id") >= 0, o).otherwise(d) for o, d in zip(others, dim, strict=True)])
    return points.withColumns(dict(zip(("show_r", "show_g", "show_b"), picked, strict=True)))


def highlight_region(points: DataFrame, region: DataFrame, factor: float = 0.22) -> DataFrame:
    """Colours that show the points of ``region`` (point_id): they in green, the rest dark. A region without points is an error."""
    ids = region.select("point_id").distinct().join(points.select("point_id"), "point_id", "left_semi")
    if ids.isEmpty():
        raise ValueError("the region has no points to highlight")
    joined = points.join(ids.withColumn("_in", F.lit(True)), "point_id", "left")
    picked = colours.chosen([(F.col("_in"), colours.HIGHLIGHT)], colours.dimmed(colours.channels(), factor))
    return joined.withColumns(dict(zip(("show_r", "show_g", "show_b"), picked, strict=True))).drop("_in")


def segment_colors(points: DataFrame, membership: DataFrame) -> DataFrame:
    """Colours that show the segments (facade_id, point_id); points of none are dark."""
    last = membership.groupBy("point_id").agg(F.max("facade_id").alias("segment"))
    shown = colours.by_segment(F.coalesce("segment", F.lit(-1)))
    return points.join(last, "point_id", "left").withColumns(dict(zip(("show_r", "show_g", "show_b"), shown, strict=True))).drop("segment")
