"""Plane fits, records of planes, and RANSAC hypotheses, as aggregates.

A least-squares plane needs nine sums, so a fit of any size is one partial aggregation with a closed-form eigenvector
(Smith, 1961) on the group's row.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators.storage import stored

P = ("x", "y", "z")
#: Columns of a plane; not a to d, as b also is a colour.
PLANE = ("na", "nb", "nc", "nd")
#: Points that are compared with a plane at a time.
CHUNK = 8192


def fit(points: DataFrame, *keys: str, exact: bool = False) -> DataFrame:
    """keys, n, centre cx, cy, cz and plane na, nb, nc, nd of each group.

    The normal is the direction of least spread, its largest component positive. Under three points, or without any
    spread, it is (0, 0, 1); under three points d is 0. With ``exact``, the centre is that of whole nanometres, summed without rounding: sums of
    millions of doubles are off by more than a gap's last digit, and by another amount for another order of rows.
    """
    second = [F.covar_pop(p, q).alias(f"_{p}{q}") for i, p in enumerate(P) for q in P[i:]]
    mean = (lambda p: F.sum(F.floor(F.col(p) * 1e9 + 0.5).cast("decimal(20,0)")).cast("double") / 1e9 / F.count(p)) if exact else F.avg
    return solve(points.groupBy(*keys).agg(F.count("*").alias("n"), *[mean(p).alias(f"c{p}") for p in P], *second), *keys)


def solve(sums: DataFrame, *keys: str) -> DataFrame:
    """``fit`` from each group's number, centre and covariances: n, cx, cy, cz, _xx, _xy, _xz, _yy, _yz, _zz."""
    xx, xy, xz, yy, yz, zz = (F.col(f"_{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    q = (xx + yy + zz) / 3
    spread = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    s = sums.withColumn("_q", q).withColumn("_p", spread)
    q, p = F.col("_q"), F.col("_p")
    det = F.when(p > 0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (p * p * p))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    s = s.withColumn("_l", q + 2 * p * F.cos(angle + 2 * math.pi / 3))
    low = F.col("_l")
    rows = [(xx - low, xy, xz), (xy, yy - low, yz), (xz, yz, zz - low)]
    crosses = [g.cross(rows[0], rows[1]), g.cross(rows[0], rows[2]), g.cross(rows[1], rows[2])]
    s = s.withColumn("_best", F.greatest(*[F.struct(g.dot(c, c).alias("n"), c[0].alias("x"), c[1].alias("y"), c[2].alias("z")) for c in crosses]))
    size = F.sqrt(F.col("_best.n"))
    valid = (F.col("n") >= 3) & (p > 0) & (size > 0)
    raw = [F.when(valid, F.col(f"_best.{k}") / size).otherwise(v) for k, v in zip(P, (0.0, 0.0, 1.0), strict=True)]
    s = s.withColumn("_n", F.array(*raw))
    nx, ny, nz = (F.col("_n")[i] for i in range(3))
    largest = F.when((F.abs(nz) >= F.abs(nx)) & (F.abs(nz) >= F.abs(ny)), nz).when(F.abs(ny) >= F.abs(nx), ny).otherwise(nx)
    sign = F.when(largest < 0, -1.0).otherwise(1.0)
    normal = [(c * sign).alias(k) for c, k in zip((nx, ny, nz), PLANE, strict=False)]
    d = F.when(F.col("n") < 3, 0.0).otherwise(-sign * g.dot((nx, ny, nz), ("cx", "cy", "cz"))).alias("nd")
    # a generator, so that the optimizer does not copy the solution into filters above it
    return s.select(*keys, F.inline(F.array(F.struct("n", "cx", "cy", "cz", *normal, d))))


def with_plane(points: DataFrame, planes: DataFrame, *keys: str) -> DataFrame:
    """Each point with its group's plane. A plane table has one row a group; it is stored, so that Spark knows its size and broadcasts it
    while it is small: dealing points by group would put a wall in one task."""
    return points.join(stored(planes.select(*keys, *PLANE, "cx", "cy", "cz")), list(keys))


def with_uv(points: DataFrame, planes: DataFrame, *keys: str) -> DataFrame:
    """``with_plane``, and each point's u and v in it; a plane's axes are found once a plane, not once a point."""
    names = [[f"_{a}{p}" for p in P] for a in "uv"]
    axes = [c.alias(n) for axis, own in zip(g.plane_axes(PLANE[:3]), names, strict=True) for c, n in zip(axis, own, strict=True)]
    joined = points.join(stored(planes.select(*keys, *PLANE, "cx", "cy", "cz", *axes)), list(keys))
    u, v = g.uv(P, ("cx", "cy", "cz"), names)
    return joined.withColumns({"u": u, "v": v}).drop(*names[0], *names[1])


def records(points: DataFrame, planes: DataFrame, *keys: str) -> DataFrame:
    """Record of each plane: type, angles, centre, spread of unsigned distances and (u, v) bounds."""
    planes = stored(planes)
    measured = with_uv(points.select(*keys, *P), planes, *keys).withColumn("_d", g.distance(P, PLANE))
    d = F.col("_d")
    stats = measured.groupBy(*keys).agg(
        F.count("*").alias("point_count"),
        F.avg(d).alias("flatness_mean"),
        F.sqrt(F.avg(d * d)).alias("flatness_rmse"),
        F.max(d).alias("flatness_max"),
        F.stddev_pop(d).alias("flatness"),
        *[f(c).alias(n) for c, n, f in (("u", "u_min", F.min), ("u", "u_max", F.max), ("v", "v_min", F.min), ("v", "v_max", F.max))],
    )
    kinds = planes.select(*keys, *PLANE, "cx", "cy", "cz", g.plane_type("nc").alias("type"), g.verticality("nc").alias("verticality"), g.horizontality("nc").alias("horizontality"))
    return kinds.join(stats, list(keys)).withColumn("area_bbox", (F.col("u_max") - F.col("u_min")) * (F.col("v_max") - F.col("v_min")))


def candidates(points: DataFrame, plane: tuple, tolerance: float, degrees: float) -> Column:
    """Points near a plane whose normals agree with it (unsigned)."""
    agree = F.abs(g.dot(("nx", "ny", "nz"), plane[:3])) >= math.cos(math.radians(degrees))
    return (g.distance(P, plane) <= tolerance) & agree


def near_facade(points: DataFrame, record, tolerance: float, padding: float = 0.0) -> DataFrame:
    """Points that belong to a facade by place alone: within the tolerance of its plane and inside its (u, v) bounds, padded.

    ``record`` is a row of ``records``.
    """
    plane, centre = [F.lit(float(record[c])) for c in PLANE], [F.lit(float(record[c])) for c in ("cx", "cy", "cz")]
    u, v = g.uv(P, centre, g.plane_axes(plane[:3]))
    placed = points.select("*", F.inline(F.array(F.struct(u.alias("_u"), v.alias("_v"), g.distance(P, plane).alias("_d")))))
    inside = F.col("_u").between(record["u_min"] - padding, record["u_max"] + padding) & F.col("_v").between(record["v_min"] - padding, record["v_max"] + padding)
    return placed.where((F.col("_d") <= tolerance) & inside).drop("_u", "_v", "_d")


def refit(points: DataFrame, tolerance: float, *keys: str) -> DataFrame:
    """Fit, drop points farther than 1.8 tolerances, fit again."""
    near = with_plane(points, fit(points, *keys), *keys).where(g.distance(P, PLANE) <= 1.8 * tolerance)
    return fit(near.select(*keys, *P), *keys)


def plane_through(a: tuple, b: tuple, c: tuple) -> tuple[float, float, float, float] | None:
    """Unit plane through three points; None if they lie on a line."""
    u, v = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    size = math.sqrt(sum(x * x for x in n))
    if size < 1e-12:
        return None
    n = tuple(x / size for x in n)
    return (*n, -sum(p * q for p, q in zip(n, a, strict=True)))


def hypotheses(points: DataFrame, trials: int, key: str = "point_id", seed: int = 17) -> list[tuple[float, float, float, float]]:
    """Planes through hash-drawn triples: the 3 * trials points that come first by a seeded hash of their key."""
    m = 2**31 - 1
    p = F.pmod(F.pmod(F.col(key), F.lit(m)).cast("long") * 48271 + seed * 40503, F.lit(m))
    place = F.pmod(p * p, F.lit(m))  # squared, so that neighbouring keys do not come in order
    rows = points.select(*P, place.alias("_h"), F.col(key).alias("_k")).orderBy("_h", "_k").limit(3 * trials).collect()
    found = (plane_through(*[tuple(r[:3]) for r in rows[i : i + 3]]) for i in range(0, len(rows) - 2, 3))
    return [p for p in found if p]


def ransac(points: DataFrame, planes: list[tuple], tolerance: float) -> tuple[int, int]:
    """(index of the plane with most inliers, their number); ties go to the first plane.

    One pass for all planes: every task counts its own points plane by plane, and the counts are summed. No row is multiplied.
    """
    if not planes:
        return 0, -1
    scaled = [(*map(float, p), math.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])) for p in planes]

    def run(batches):
        counts = np.zeros(len(scaled), np.int64)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for at in range(0, len(batch), CHUNK):
                x, y, z = (c[at : at + CHUNK] for c in columns)
                d, t = np.empty(len(x)), np.empty(len(x))
                with np.errstate(all="ignore"):
                    for i, (na, nb, nc, nd, size) in enumerate(scaled):
                        # in the order of ``geometry.signed_distance``, so that points on the tolerance fall alike
                        np.multiply(x, na, out=d)
                        np.add(d, np.multiply(y, nb, out=t), out=d)
                        np.add(d, np.multiply(z, nc, out=t), out=d)
                        np.add(d, nd, out=d)
                        if size != 1.0:
                            np.divide(d, size, out=d)
                        counts[i] += np.count_nonzero(np.abs(d, out=d) <= tolerance)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], ["plane", "n"])

    counted = points.select(*[F.col(p).cast("double") for p in P]).mapInArrow(run, "plane int, n long").groupBy("plane").agg(F.sum("n").alias("n"))
    return max(((r["plane"], r["n"]) for r in counted.collect()), key=lambda r: (r[1], -r[0]), default=(0, 0))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
