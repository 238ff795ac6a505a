"""Registration of one cloud to another: from picked pairs, and by iterative closest point.

Clouds stay in Spark; a step needs a dozen or so sums, from which the driver solves a 3x3 or 6x6 system.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry
from plumbline.operators import blocks, neighbors
from plumbline.operators.points import numbered, transform, voxel_downsample
from plumbline.operators.storage import release, stored

P = ("x", "y", "z")


def record_pairs(table: DataFrame, source: str, target: str, picked: DataFrame) -> DataFrame:
    """``table`` (source, target, pair_id, sx..sz, tx..tz, Z-up) with the pairs picked in a viewer (Y-up) in place of the two clouds' earlier ones."""
    others = table.where(~(F.col("source").eqNullSafe(F.lit(source)) & F.col("target").eqNullSafe(F.lit(target))))
    moved = {f"{e}{p}": c for e in "st" for p, c in zip(P, geometry.to_zup(*[f"{e}{p}" for p in P]), strict=True)}
    fresh = picked.withColumns(moved).withColumns({"source": F.lit(source), "target": F.lit(target)})
    return others.unionByName(fresh.select(table.columns))


def align_pairs(pairs: DataFrame) -> np.ndarray:
    """Rigid 4x4 transform from pairs sx..sz to tx..tz, least squares, never a reflection (Kabsch, 1976; Arun et al., 1987)."""
    s, t = [f"s{p}" for p in P], [f"t{p}" for p in P]
    sums = pairs.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in s + t], *[F.covar_pop(a, b).alias(f"{a}{b}") for a in s for b in t]).first()
    if sums.n < 3:
        raise ValueError("three pairs at least are needed")
    u, _, vt = np.linalg.svd(np.array([[sums[f"{a}{b}"] for b in t] for a in s]))
    turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    out = np.eye(4)
    out[:3, :3] = turn
    out[:3, 3] = np.array([sums[c] for c in t]) - turn @ np.array([sums[c] for c in s])
    return out


def packed_target(target: DataFrame, radius: float) -> DataFrame:
    """The target's blocks for a radius, its points with their normals."""
    return blocks.packed(target, blocks.WIDE * radius, carried=("nx", "ny", "nz"))


def point_to_plane_step(source: DataFrame, target: DataFrame, radius: float, packed: DataFrame | None = None, count: int | None = None) -> tuple[np.ndarray, float, float]:
    """(small rigid motion, matched share, RMSE) of one step (Chen and Medioni, 1992); target has normals. ``packed`` is ``packed_target`` for this radius,
    ``count`` the number of source points. Blocks of the source sum their own equations where they see the target, so no point is joined."""
    asking = blocks.packed(source, blocks.WIDE * radius)
    found = blocks.search(asking, packed_target(target, radius) if packed is None else packed, blocks.Steps, radius, inclusive=False, k=1)
    names = [f"a{i}{k}" for i in range(6) for k in range(i, 6)] + [f"b{i}" for i in range(6)]
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("matched", "squares", *names)]
    r = found.agg(*sums).first()
    release(asking)
    share = r.matched / max(1, source.count() if count is None else count)
    if r.matched < 6:
        return np.eye(4), share, float("inf")
    a = np.array([[r[f"a{min(i, k)}{max(i, k)}"] for k in range(6)] for i in range(6)])
    w = np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(6)]), rcond=None)[0]
    angle = float(np.linalg.norm(w[:3]))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    turn = np.eye(3) + (np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k if angle > 1e-12 else k)
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = turn, w[3:]
    return out, share, float(np.sqrt(r.squares / r.matched))


def one_a_place(target: DataFrame) -> DataFrame:
    """The target with the lowest id of each place alone: ties of a nearest point go to it, so the others are never matched."""
    first = F.min_by(F.struct("point_id", "nx", "ny", "nz"), "point_id").alias("_t")
    return target.groupBy(*P).agg(first).select("_t.point_id", *P, "_t.nx", "_t.ny", "_t.nz")


def icp(source: DataFrame, target: DataFrame, start: np.ndarray | None = None, *, voxel: float = 0.05, tolerance: float = 1e-6, caps: tuple[int, int, int] = (80, 60, 50), most: int = 2_000_000) -> tuple[np.ndarray, float, float]:
    """(transform, overlap, RMSE): a coarse, a medium and three fine passes of shrinking search radius.

    A pass ends once overlap and RMSE change by less than the tolerance, or at its cap; under 1 % overlap everything ends. The last passes thin a source of
    over ``most`` points.
    """
    v = voxel
    passes = [(max(6 * v, 0.3), caps[0], 4 * v), (max(2 * v, 0.1), caps[1], 2 * v), *[(f * v, caps[2], 0.0) for f in (6, 3, 1.5)]]
    total = np.eye(4) if start is None else np.array(start, float)
    n = source.count()
    share, targets, parts = 0.0, {}, {}
    target = stored(one_a_place(target))
    for radius, cap, thin in passes:
        if not thin and n > most:
            thin = v
        if thin not in parts:
            part = source.select("point_id", *P)
            if thin:
                part = numbered(voxel_downsample(part, thin, attributes=()), "vx", "vy", "vz", name="point_id").select("point_id", *P)
            part = stored(part)
            parts[thin] = part, part.count()
        (part, size), before = parts[thin], None
        if radius not in targets:
            targets[radius] = packed_target(target, radius)
        for _ in range(cap):
            motion, share, rmse = point_to_plane_step(transform(part, total), target, radius, targets[radius], size)
            if share < 0.01:
                return total, share, float("inf")
            total = motion @ total
            if before and abs(before[0] - share) < tolerance and abs(before[1] - rmse) < tolerance:
                break
            before = (share, rmse)
    r = neighbors.registration_error(transform(source, total), target, 5 * v).first()
    return total, r.overlap, r.rmse


def apply_saved(source: DataFrame, target: DataFrame, transformation, *, radius: float = 1.0) -> tuple[DataFrame, float, float]:
    """(moved source, RMSE, overlap): a saved 4 x 4 transformation, as rows or as sixteen numbers, applied to the original cloud and measured anew."""
    m = np.array(transformation, float)
    if m.size != 16:
        raise ValueError("the transformation must be a 4 x 4 matrix")
    moved = transform(source, m.reshape(4, 4).tolist())
    r = neighbors.registration_error(moved, target, radius).first()
    return moved, r.rmse, r.overlap
