"""A step of iterative closest point sums its equations where source blocks see the target; no table of matched points is joined."""

import numpy as np
import pytest

from plumbline.operators import register


def test_a_step_equals_brute_force_without_a_table_of_matches(spark, monkeypatch):
    rng = np.random.default_rng(8)
    t = rng.uniform(0, 3, (900, 3))
    n = rng.normal(size=(900, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    s = np.concatenate((t[::2] + rng.normal(0, 0.02, (450, 3)), [[50.0, 50.0, 50.0]]))
    target = spark.createDataFrame([(i, *map(float, (*p, *k))) for i, (p, k) in enumerate(zip(t, n, strict=True))], "point_id long, x double, y double, z double, nx double, ny double, nz double")
    source = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(s)], "point_id long, x double, y double, z double")
    monkeypatch.setattr(register.neighbors, "nearest", lambda *a, **k: pytest.fail("matches were listed"))
    motion, share, rmse = register.point_to_plane_step(source, target, 0.3)
    d = np.sqrt(((s[:, None] - t[None]) ** 2).sum(axis=2))
    best, near = d.argmin(axis=1), d.min(axis=1) < 0.3
    p, q, k = s[near], t[best[near]], n[best[near]]
    w = np.linalg.lstsq(np.column_stack((np.cross(p, k), k)), ((q - p) * k).sum(axis=1), rcond=None)[0]
    assert (share, rmse) == (pytest.approx(near.sum() / len(s)), pytest.approx(np.sqrt((d.min(axis=1)[near] ** 2).mean())))
    assert motion[:3, 3] == pytest.approx(w[3:], abs=1e-9)
    far = register.point_to_plane_step(source.where("x > 40"), target, 0.3)
    assert (far[0] == np.eye(4)).all() and far[1:] == (0.0, float("inf"))
    assert register.point_to_plane_step(source.where("false"), target, 0.3)[1] == 0.0


def test_copies_of_a_target_place_are_left_out_but_the_lowest_id(spark):
    """A nearest point's ties go to the lower id, so other copies of its place are never matched."""
    rows = [(10 * i + c, float(i), 0.0, 0.5, float(c == 0), 0.0, float(c > 0)) for i in range(20) for c in range(7)]
    target = spark.createDataFrame(rows, "point_id long, x double, y double, z double, nx double, ny double, nz double")
    kept = register.one_a_place(target).collect()
    assert sorted((r.point_id, r.x, r.nx, r.nz) for r in kept) == [(10 * i, float(i), 1.0, 0.0) for i in range(20)]
    source = target.select("point_id", "x", "y", "z").where("point_id % 10 < 2")
    whole, lone = (register.point_to_plane_step(source, t, 0.3) for t in (target, register.one_a_place(target)))
    assert np.allclose(whole[0], lone[0]) and whole[1:] == lone[1:]
