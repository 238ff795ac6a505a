import numpy as np
import pytest

from plumbline.operators import pose
from plumbline.plans import scene

PHOTO = "photo_id int, width double, height double, focal double, degrees double"
PAIRS = "photo_id int, pair_id int, x double, y double, z double, px double, py double, note string"
CAMERA = np.concatenate((np.array(scene.POSE["rotation"]).ravel(), scene.POSE["translation"], [1000.0, 960.0, 540.0], [0.0] * 5))


def seen(world, camera=CAMERA):
    return world, pose.residuals(camera[None], np.column_stack((world, np.zeros((len(world), 2))))[None])[0][0]


def rows(photo, world, pixels):
    return [(photo, i, *map(float, w), *map(float, p), "extra") for i, (w, p) in enumerate(zip(world, pixels, strict=True))]


def box(n, seed=5):
    rng = np.random.default_rng(seed)
    return np.column_stack((rng.uniform(0, 25, n), rng.uniform(0, 8, n), rng.uniform(0, 50, n)))


def test_turns():
    w = np.array([[0.3, -0.2, 0.9], [0.0, 0.0, 0.0], [0.0, np.pi / 2, 0.0]])
    r = pose.turn_of(w)
    assert np.allclose(r @ np.swapaxes(r, 1, 2), np.eye(3)) and np.allclose(np.linalg.det(r), 1)
    assert np.allclose(r[2], [[0, 0, 1], [0, 1, 0], [-1, 0, 0]])
    assert np.allclose(pose.vector_of(r[0]), w[0])


def test_derivatives():
    camera = CAMERA.copy()
    camera[pose.K1 :] = [-0.05, 0.01, 0.001, -0.002, 0.003]
    world, pixels = seen(box(7), camera)
    pairs = np.column_stack((world, pixels + 3.0))[None]
    full = np.zeros((9, 9))
    full[np.triu_indices(9)] = pose.equations(camera[None], pairs, np.ones((1, 7)))[0]
    j = np.empty((14, 9))
    for i in range(8):
        got = []
        for h in (1e-6, -1e-6):
            p, d = camera.copy(), np.zeros(8)
            d[i] = h
            p[:9] = (pose.turn_of(d[:3]) @ p[:9].reshape(3, 3)).ravel()
            p[9:12] += d[3:6]
            p[pose.FOCAL] += d[6]
            p[pose.K1] += d[7]
            got.append(pose.residuals(p[None], pairs)[0].ravel())
        j[:, i] = (got[0] - got[1]) / 2e-6
    j[:, 8] = pose.residuals(camera[None], pairs)[0].ravel()
    want = np.triu(j.T @ j)
    scale = np.sqrt(np.outer(np.diag(want), np.diag(want)))
    assert np.abs((full - want) / scale).max() < 1e-5


def test_many_photos(spark, monkeypatch):
    monkeypatch.setattr(pose, "BLOCK", 16)  # several blocks a photo
    world, pixels = seen(box(50))
    wrong = pixels.copy()
    wrong[::10] += 400.0
    flat, on_wall = seen(np.column_stack((box(5, 8)[:, 0], np.zeros(5), box(5, 8)[:, 2])))
    data = rows(1, world, wrong) + rows(2, flat, on_wall) + rows(3, world[:3], pixels[:3]) + rows(4, world[:6], pixels[:6])
    data += [(4, 9, None, 0.0, 0.0, 1.0, 1.0, "null"), (None, 1, 0.0, 0.0, 0.0, 0.0, 0.0, "no photo"), (8, 1, 0.0, 0.0, 0.0, 0.0, 0.0, "unknown photo")]
    photos = [(i, 1920.0, 1080.0, 1000.0, None) for i in (1, 2, 3, 4)] + [(5, 1920.0, 1080.0, None, 60.0)]
    pairs = spark.createDataFrame(data, PAIRS)
    solved = pose.poses(spark.createDataFrame(photos, PHOTO), pairs, trials=30)
    got = {r.photo_id: r for r in solved.collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for i, n in ((1, 45), (2, 5)):
        assert got[i].inliers == n and got[i].rmse < 1e-6 and got[i].max_error < 1e-6 and got[i].message is None
        assert got[i].intrinsics == "provided" and np.allclose(got[i].centre, [10, -60, 25], atol=1e-6)
    assert "four" in got[3].message or "4 pairs" in got[3].message
    assert "finite" in got[4].message and got[4].rotation is None and "pairs" in got[5].message
    errors = {r.pair_id: r for r in pose.pair_errors(solved, pairs).where("photo_id = 1").collect()}
    assert len(errors) == 50 and all(r.inlier == (i % 10 != 0) and (r.error > 500) == (i % 10 == 0) for i, r in errors.items())
    moved = np.concatenate((CAMERA[:9], CAMERA[9:12] + 0.5, CAMERA[12:])).tolist()
    again = pose.refined(spark.createDataFrame([(1, moved), (3, moved)], "photo_id int, params array<double>"), spark.createDataFrame(rows(1, world, pixels) + rows(3, world[:3], pixels[:3]), PAIRS))
    kept = {r.photo_id: r for r in again.collect()}
    assert kept[1].rmse < 1e-6 and kept[1].inliers == 50 and kept[1].focal == 1000.0 and kept[3].message


def test_calibration_with_k1(spark):
    camera = CAMERA.copy()
    camera[pose.FOCAL], camera[pose.K1] = 1200.0, -0.12
    world, pixels = seen(box(30, 3), camera)
    got = pose.poses(spark.createDataFrame([(1, 1920.0, 1080.0, None, 60.0)], PHOTO), spark.createDataFrame(rows(1, world, pixels), PAIRS), trials=10).first()
    assert got.intrinsics == "calibrated_focal_k1" and abs(got.focal - 1200) < 0.01 and abs(got.distortion[0] + 0.12) < 1e-5 and got.inliers == 30


def test_no_photos(spark):
    solved = pose.poses(spark.createDataFrame([], PHOTO), spark.createDataFrame([], PAIRS))
    assert solved.count() == 0 and "rotation" in solved.columns


def test_single_needs_six(spark):
    world, pixels = seen(box(5))
    with pytest.raises(ValueError):
        pose.solve(spark, world, pixels, 1920, 1080)


def test_few_problems_do_not_move_the_pairs(spark, monkeypatch):
    """Sums over blocks are the same whether problems go to every task or are dealt with the blocks, and the first way shuffles no block."""
    world, pixels = seen(box(100))
    monkeypatch.setattr(pose, "BLOCK", 16)
    pairs = spark.createDataFrame(rows(1, world, pixels) + rows(2, world[:40], pixels[:40]), PAIRS)
    photos = spark.createDataFrame([(1,), (2,)], "photo_id int")
    blocks = pose.packed(pose.placed(photos, pairs))
    problems = spark.createDataFrame([(p, i, (CAMERA + 0.01 * i).tolist()) for p in (1, 2) for i in range(150)], "photo_id int, part int, params array<double>")
    run = lambda c, q: np.column_stack((np.full(len(c["params"]), q.shape[1]), pose.distances(c["params"], q).sum(1)))
    few = pose.over_pairs(problems, blocks, ["params"], 2, run)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(pose, "FEW", 0)
    got, want = ({(r.photo_id, r.part): r.found for r in df.collect()} for df in (few, pose.over_pairs(problems, blocks, ["params"], 2, run)))
    assert got.keys() == want.keys() and len(got) == 300 and {k[0]: v[0] for k, v in got.items()} == {1: 100, 2: 40}
    assert all(np.allclose(got[k], want[k], rtol=1e-12) for k in got)


def test_a_block_is_worked_a_few_problems_at_a_time(spark):
    """The numbers of a step fit a core's cache: no more problems meet a block at once than ``AT_ONCE``."""
    world, pixels = seen(box(20))
    blocks = pose.packed(pose.placed(spark.createDataFrame([(1,)], "photo_id int"), spark.createDataFrame(rows(1, world, pixels), PAIRS)))
    problems = spark.createDataFrame([(1, i, CAMERA.tolist()) for i in range(30)], "photo_id int, part int, params array<double>")
    got = pose.over_pairs(problems, blocks, ["params"], 1, lambda c, q: np.full((len(c["params"]), 1), len(c["params"]))).collect()
    assert len(got) == 30 and max(r.found[0] for r in got) == pose.AT_ONCE
