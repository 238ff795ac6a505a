"""Camera poses from picked pairs of photo and cloud points, for all photos at once.

``photos`` has photo_id, width, height, focal (null: to be found) and degrees (the assumed horizontal field of view); ``pairs`` has photo_id, pair_id,
x, y, z, px, py. Other columns are ignored. Everything is a Spark table: intrinsic candidates of a photo, random samples of six pairs and the poses they give,
inliers of every pose under every threshold, and the refits. Least squares (Levenberg-Marquardt) is a loop over one aggregation: tasks sum the normal equations of
their pairs, one small system a problem gives the next parameters. Pairs are packed in blocks of ``BLOCK`` and problems in chunks of ``CHUNK``, which meet by photo
and block number, so a photo's pairs are never gathered and a photo with very many is dealt like many photos.

Parameters are twenty numbers: rotation by rows, translation, focal length, principal point, k1, k2, p1, p2, k3.

Edge cases: photos with fewer than four pairs, or with null, NaN or infinite ones, keep their row with a message and no pose; so do photos without any pose of
three inliers. Pairs of no photo are left out. Ties go to the earlier candidate, method, threshold and sample. Repeated pairs count as often as they stand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import five, sane_focal
from plumbline.operators.points import numbered
from plumbline.operators.storage import release, stored

PAIR = ("x", "y", "z", "px", "py")
#: Fields of view (degrees) and inlier thresholds (pixels) that are tried besides the caller's.
DEGREES = (40.0, 50.0, 55.0, 60.0, 65.0, 70.0, 80.0, 90.0)
THRESHOLDS = (12.0, 20.0, 30.0, 45.0, 60.0, 80.0)
#: Ways from a sample to a pose: by the plane through it, and by a direct linear transform.
METHODS = ("planar", "linear")
SAMPLE, BLOCK, CHUNK = 6, 1024, 64
#: Problems that a task works at a time, so that their numbers stay in a core's cache, and problems that are sent to every task.
AT_ONCE, FEW = 8, 20_000
#: Where the focal length and k1 stand among the parameters.
FOCAL, K1 = 12, 15
_UPPER = np.triu_indices(9)
_FAR = 1e12


def turn_of(w: np.ndarray) -> np.ndarray:
    """Rotations (m, 3, 3) of rotation vectors (m, 3), or one of one (Rodrigues)."""
    w = np.asarray(w, float)
    k = np.zeros((*w.shape[:-1], 3, 3))
    k[..., 2, 1], k[..., 0, 2], k[..., 1, 0] = w[..., 0], w[..., 1], w[..., 2]
    k -= np.swapaxes(k, -1, -2)
    angle = np.linalg.norm(w, axis=-1)[..., None, None]
    return np.eye(3) + np.sinc(angle / np.pi) * k + 0.5 * np.sinc(angle / (2 * np.pi)) ** 2 * (k @ k)


def vector_of(r: np.ndarray) -> np.ndarray:
    angle = float(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1)))
    if angle < 1e-9:
        return np.zeros(3)
    if np.pi - angle < 1e-6:
        m = (r + np.eye(3)) / 2
        axis = m[:, int(np.argmax(np.diag(m)))]
        return angle * axis / np.linalg.norm(axis)
    return angle / (2 * np.sin(angle)) * np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])


def residuals(p: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Pixel errors (m, k, 2) of parameters (m, 20) over pairs (m or 1, k, 5), and what their derivatives need."""
    q = pairs[..., :3] @ np.swapaxes(p[:, :9].reshape(-1, 3, 3), 1, 2)
    s = q + p[:, None, 9:12]
    z = np.where(np.abs(s[..., 2]) < 1e-9, 1e-9, s[..., 2])
    x, y = s[..., 0] / z, s[..., 1] / z
    k1, k2, p1, p2, k3 = (p[:, i, None] for i in range(K1, 20))
    rr = x * x + y * y
    radial = 1 + rr * (k1 + rr * (k2 + rr * k3))
    xd = x * radial + 2 * p1 * x * y + p2 * (rr + 2 * x * x)
    yd = y * radial + p1 * (rr + 2 * y * y) + 2 * p2 * x * y
    f = p[:, FOCAL, None]
    off = np.stack((f * xd + p[:, 13, None] - pairs[..., 3], f * yd + p[:, 14, None] - pairs[..., 4]), -1)
    return off, (q, z, x, y, rr, radial, xd, yd)


def distances(p: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Pixel distances (m, k); what is not a number is far."""
    d = np.linalg.norm(residuals(p, pairs)[0], axis=-1)
    return np.where(np.isfinite(d), np.minimum(d, _FAR), _FAR)


def equations(p: np.ndarray, pairs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums (m, 45) over pairs of products of derivatives (turn, move, focal, k1) and error: the normal equations' upper half and the squared error."""
    off, (q, z, x, y, rr, radial, xd, yd) = residuals(p, pairs)
    k1, k2, p1, p2, k3 = (p[:, i, None] for i in range(K1, 20))
    f, bend = p[:, FOCAL, None], k1 + rr * (2 * k2 + 3 * k3 * rr)
    mixed = 2 * x * y * bend + 2 * p1 * x + 2 * p2 * y
    along = (radial + 2 * x * x * bend + 2 * p1 * y + 6 * p2 * x, mixed), (mixed, radial + 2 * y * y * bend + 6 * p1 * y + 2 * p2 * x)
    g = np.empty((*off.shape, 9))
    for i, ((by_x, by_y), flat) in enumerate(zip(along, (xd, yd), strict=True)):
        move = np.stack((f * by_x / z, f * by_y / z, -f * (by_x * x + by_y * y) / z), -1)
        g[..., i, :3], g[..., i, 3:6] = np.cross(q, move), move
        g[..., i, 6], g[..., i, 7], g[..., i, 8] = flat, f * (x, y)[i] * rr, off[..., i]
    g = np.where((weight > 0)[..., None, None], g, 0).reshape(len(p), -1, 9)
    return (np.swapaxes(g, 1, 2) @ g)[:, _UPPER[0], _UPPER[1]]


def changed(p: np.ndarray, sums: np.ndarray, damp: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Parameters after one damped step; ``free`` says how many of turn, move, focal and k1 may change."""
    a = np.zeros((len(p), 9, 9))
    a[:, _UPPER[0], _UPPER[1]] = np.where(np.isfinite(sums), sums, 0)
    held = np.arange(8) >= free[:, None]
    a, b = a + np.triu(np.ones((9, 9)), 1).T * np.swapaxes(a, 1, 2), np.where(held, 0, a[:, :8, 8])
    a = np.where(held[:, :, None] | held[:, None, :], 0, a[:, :8, :8])
    size = np.sqrt(np.diagonal(a, axis1=1, axis2=2)) + 1e-9
    scaled = a / size[:, :, None] / size[:, None, :] + np.eye(8) * (damp[:, None, None] + held[:, :, None])
    d = -np.linalg.solve(scaled, (b / size)[..., None])[..., 0] / size
    d[:, :3] *= np.minimum(1, 1 / np.maximum(np.linalg.norm(d[:, :3], axis=1, keepdims=True), 1e-12))
    out = p.copy()
    out[:, :9] = (turn_of(d[:, :3]) @ p[:, :9].reshape(-1, 3, 3)).reshape(-1, 9)
    out[:, 9:12] += d[:, 3:6]
    out[:, FOCAL] = np.maximum(out[:, FOCAL] + d[:, 6], 1e-3)
    out[:, K1] += d[:, 7]
    return out


def judged(best, known, tried, fresh, damp, free):
    """One Levenberg-Marquardt decision: (best, its sums, next try, damping, whether to go on)."""
    new = np.where(np.isfinite(fresh[:, -1]), fresh[:, -1], np.inf)
    old = known[:, -1]
    good = new < old
    best, known = np.where(good[:, None], tried, best), np.where(good[:, None], fresh, known)
    with np.errstate(invalid="ignore"):
        done = np.abs(old - new) < 1e-9 * (0.01 + old)  # a step that changes nothing, for better or worse
    done &= np.isfinite(old)
    damp = np.where(good, np.maximum(damp / 5, 1e-10), damp * 6)
    return best, known, changed(best, known, damp, free), damp, ~done & (damp < 1e9)


def nearest_turn(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    u[:, :, 2] *= np.linalg.det(u @ vt)[:, None]
    return u @ vt


def start_poses(camera: np.ndarray, pairs: np.ndarray, method: int) -> np.ndarray:
    """First poses of samples (m, k, 5), refitted to them; the camera's (m, 20) distortion counts in the refit only."""
    m, k = pairs.shape[:2]
    world, x = pairs[..., :3], (pairs[..., 3:] - camera[:, None, 13:15]) / camera[:, None, FOCAL, None]
    mean = world.mean(1, keepdims=True)
    size = np.sqrt(((world - mean) ** 2).sum(2).mean(1))[:, None, None] + 1e-12
    w = (world - mean) / size
    axes = np.linalg.eigh(np.swapaxes(w, 1, 2) @ w)[1][:, :, ::-1]  # by falling spread
    axes[:, :, 2] = np.cross(axes[:, :, 0], axes[:, :, 1])
    n = 3 if method == 0 else 4
    h = np.concatenate(((w @ axes)[..., : n - 1], np.ones((m, k, 1))), 2)
    rows = np.zeros((m, 2 * k, 3 * n))
    rows[:, :k, :n] = rows[:, k:, n : 2 * n] = h
    rows[:, :k, 2 * n :], rows[:, k:, 2 * n :] = -x[..., :1] * h, -x[..., 1:] * h
    got = np.linalg.eigh(np.swapaxes(rows, 1, 2) @ rows)[1][:, :, 0].reshape(m, 3, n)
    got *= np.where((h @ got[:, 2, :, None]).sum((1, 2)) < 0, -1, 1)[:, None, None]
    if method == 0:
        scale = np.linalg.norm(got[:, :, :2], axis=1).mean(1)[:, None, None] + 1e-12
        a, b = got[:, :, 0], got[:, :, 1]
        turn = nearest_turn(np.stack((a, b, np.cross(a, b) / scale[:, 0]), 2))
    else:
        scale = np.linalg.svd(got[:, :, :3])[1].mean(1)[:, None, None] + 1e-12
        turn = nearest_turn(got[:, :, :3])
    turn = turn @ np.swapaxes(axes, 1, 2)
    p = camera.copy()
    p[:, :9] = turn.reshape(m, 9)
    p[:, 9:12] = (got[:, :, -1:] / scale * size - turn @ np.swapaxes(mean, 1, 2))[:, :, 0]
    every, free, damp = np.ones((m, k)), np.full(m, 6), np.full(m, 1e-3)
    best, known, tried = p, np.full((m, 45), np.inf), p
    for _ in range(10):
        best, known, tried, damp, _ = judged(best, known, tried, equations(tried, pairs, every), damp, free)
    return best


# ---- tables


def checked(photos: DataFrame, pairs: DataFrame, least: int = 4) -> DataFrame:
    """``photos`` with their number of ``pairs`` and a message where those cannot give a pose (null where they can)."""
    fine = F.lit(True)
    for c in PAIR:
        fine = fine & F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    n = pairs.groupBy("photo_id").agg(F.count("*").alias("pairs"), F.count_if(~fine).alias("broken"))
    message = F.when(F.coalesce("pairs", F.lit(0)) < least, f"{least} pairs at least are needed").when(F.col("broken") > 0, "pairs must be finite numbers")
    return photos.join(n, "photo_id", "left").withColumns({"message": message, "pairs": F.coalesce("pairs", F.lit(0))}).drop("broken")


def camera_of(focal: Column, width: str = "width", height: str = "height") -> Column:
    """Twenty parameters of a camera without a pose or distortion."""
    return F.concat(F.array(*[F.lit(float(i in (0, 4, 8))) for i in range(12)]), F.array(focal.cast("double"), F.col(width) / 2, F.col(height) / 2, *[F.lit(0.0)] * 5))


def guesses(photos: DataFrame) -> DataFrame:
    """photo_id, candidate, intrinsics, params: the given focal length alone, or one for each field of view (numbered from 2, behind calibrations)."""
    given = F.col("focal").isNotNull()
    angles = F.array_sort(F.array_distinct(F.array(F.coalesce(F.col("degrees").cast("double"), F.lit(60.0)), *map(F.lit, DEGREES))))
    each = photos.select("*", F.posexplode(F.when(given, F.array(F.lit(0.0))).otherwise(angles)).alias("at", "angle"))
    wide = F.col("width") / (2 * F.tan(F.radians(F.least(F.lit(150.0), F.greatest(F.lit(10.0), F.col("angle")))) / 2))
    name = F.when(given, "provided").otherwise(F.format_string("fov_guess_%.0fdeg", "angle"))
    return each.select("photo_id", F.when(given, 0).otherwise(F.col("at") + 2).alias("candidate"), name.alias("intrinsics"), camera_of(F.coalesce("focal", wide)).alias("params"))


def placed(photos: DataFrame, pairs: DataFrame) -> DataFrame:
    """The photos' pairs with their place 0, 1, ... in their photo."""
    own = numbered(pairs.select("photo_id", "pair_id", *[F.col(c).cast("double") for c in PAIR]).join(photos.select("photo_id"), "photo_id"), "photo_id", "pair_id", *PAIR)
    # one row a photo, of known size: no photo's pairs are dealt to one task
    first = own.groupBy("photo_id").agg(F.min("number").alias("first"))
    return stored(own.join(stored(first), "photo_id").withColumn("place", F.col("number") - F.col("first")).drop("number", "first"))


def packed(pairs: DataFrame) -> DataFrame:
    """photo_id, block, data: pairs by ``BLOCK``, in the order of their places."""
    rows = F.array_sort(F.collect_list(F.struct("place", F.array(*PAIR).alias("v"))))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.withColumn("block", F.floor(F.col("place") / BLOCK)).repartition(tasks, "photo_id", "block")
    return stored(dealt.groupBy("photo_id", "block").agg(F.flatten(F.transform(rows, lambda r: r["v"])).alias("data")))


def samples(photos: DataFrame, pairs: DataFrame, trials: int) -> DataFrame:
    """photo_id, trial, data: six pairs drawn by hash for each trial, all of them where there are no more."""
    few = F.col("pairs") <= SAMPLE
    trial = F.explode(F.sequence(F.lit(0), F.when(few, 0).otherwise(trials - 1))).alias("trial")
    drawn = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.pmod(F.xxhash64("photo_id", "trial", i), F.col("pairs")))
    places = F.when(few, F.sequence(F.lit(0).cast("long"), F.col("pairs") - 1)).otherwise(F.slice(F.array_distinct(drawn), 1, SAMPLE))
    wanted = photos.select("photo_id", "pairs", trial).select("photo_id", "trial", F.explode(places).alias("place"))
    rows = F.array_sort(F.collect_list(F.struct("place", F.array(*PAIR).alias("v"))))
    return stored(wanted).join(pairs, ["photo_id", "place"]).groupBy("photo_id", "trial").agg(F.flatten(F.transform(rows, lambda r: r["v"])).alias("data"))


def hypotheses(candidates: DataFrame, drawn: DataFrame) -> DataFrame:
    """photo_id, candidate, method, trial, params: a pose of every sample by every method under every candidate."""

    def run(frames):
        for f in frames:
            for size, part in f.groupby(f["data"].map(len)):
                camera = np.stack(part["params"].to_list())
                sample = np.stack(part["data"].to_list()).reshape(len(part), size // 5, 5)
                for m in range(len(METHODS)):
                    if m == 1 and size < 5 * SAMPLE:
                        continue
                    p = start_poses(camera, sample, m)
                    fine = np.isfinite(p).all(1)
                    yield part.drop(columns="data").assign(method=m, params=list(p))[["photo_id", "candidate", "method", "trial", "params"]][fine]

    rows = candidates.select("photo_id", "candidate", "params").join(drawn, "photo_id")
    kind = candidates.schema["photo_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"photo_id {kind}, candidate int, method int, trial int, params array<double>")


def over_pairs(problems: DataFrame, blocks: DataFrame, carried: list[str], width: int, reduce, least_last: bool = False) -> DataFrame:
    """photo_id, part, found: ``reduce(columns, pairs)`` gives (problems, width) for a block; sums over blocks (the last number by maximum on request).
    While problems are few, all go to every task and blocks stay where they are; else both are dealt by photo and block."""
    chunk = problems.groupBy("photo_id", F.floor(F.col("part") / CHUNK).alias("chunk")).agg(F.collect_list(F.struct("part", *carried)).alias("held"))
    if problems.count() <= FEW:
        met = blocks.join(F.broadcast(chunk), "photo_id")
    else:
        count = blocks.groupBy("photo_id").agg(F.max("block").alias("last"))
        spread = chunk.join(count, "photo_id").select("photo_id", "held", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
        met = spread.join(blocks, ["photo_id", "block"])
    names = [f"s{i}" for i in range(width)]

    def run(frames):
        for f in frames:
            for photo, held, data in zip(f["photo_id"], f["held"], f["data"], strict=True):
                columns = {c: np.array([h[c] for h in held], float) for c in carried}
                block = np.asarray(data, float).reshape(1, -1, 5)
                parts = [{c: v[i : i + AT_ONCE] for c, v in columns.items()} for i in range(0, len(held), AT_ONCE)]
                out = pd.DataFrame(np.concatenate([reduce(part, block) for part in parts]), columns=names)
                out.insert(0, "part", [h["part"] for h in held])
                out.insert(0, "photo_id", photo)
                yield out

    kind = problems.schema["photo_id"].dataType.simpleString()
    sums = met.select("photo_id", "held", "data").mapInPandas(run, f"photo_id {kind}, part int, " + ", ".join(f"{n} double" for n in names))
    folds = [(F.max if least_last and n == names[-1] else F.sum)(n).alias(n) for n in names]
    return sums.groupBy("photo_id", "part").agg(*folds).select("photo_id", "part", F.array(*names).alias("found"))


def _chosen(c: dict, pairs: np.ndarray) -> np.ndarray:
    """Which pairs count: those within the threshold of the pose that was chosen, or all."""
    return distances(c["chosen"], pairs) <= c["threshold"][:, None]


def fitted(problems: DataFrame, blocks: DataFrame, rounds: int = 40) -> DataFrame:
    """``problems`` (photo_id, part, params, chosen, threshold, free; others kept) with params fitted to the pairs that ``chosen`` has within the threshold."""
    columns = problems.columns
    state = stored(problems.withColumns({"known": F.array_repeat(F.lit(float("inf")), 45), "tried": F.col("params"), "damp": F.lit(1e-3), "moving": F.lit(True)}))

    def step(frames):
        for f in frames:
            if len(f):
                array = lambda c: np.stack(f[c].to_list()).astype(float)  # noqa: B023, E731
                best, known, tried, damp, on = judged(array("params"), array("known"), array("tried"), array("found"), f["damp"].to_numpy(), f["free"].to_numpy())
                yield f.drop(columns="found").assign(params=list(best), known=list(known), tried=list(tried), damp=damp, moving=on)

    for _ in range(rounds):
        live = state.where("moving")
        found = over_pairs(live, blocks, ["tried", "chosen", "threshold"], 45, lambda c, pairs: equations(c["tried"], pairs, _chosen(c, pairs)))
        moved = live.join(found, ["photo_id", "part"]).select(*state.columns, "found").mapInPandas(step, state.schema)
        after = stored(state.where("not moving").unionByName(moved))
        release(state)
        state = after
        if state.where("moving").isEmpty():
            break
    out = state.select(columns)
    out._plumbline_path = state._plumbline_path  # for release
    return out


def measured(problems: DataFrame, blocks: DataFrame) -> DataFrame:
    """``problems`` with inliers, rmse, mean_error and max_error over the pairs that count."""

    def run(c, pairs):
        inside, d = _chosen(c, pairs), distances(c["params"], pairs)
        return np.column_stack((inside.sum(1), np.where(inside, d, 0).sum(1), np.where(inside, d * d, 0).sum(1), np.where(inside, d, 0).max(1)))

    n, total, squares, most = (F.col("found")[i] for i in range(4))
    got = over_pairs(problems, blocks, ["params", "chosen", "threshold"], 4, run, least_last=True)
    numbers = {"inliers": n.cast("long"), "rmse": F.sqrt(F.try_divide(squares, n)), "mean_error": F.try_divide(total, n), "max_error": most}
    return problems.join(got, ["photo_id", "part"]).withColumns(numbers).drop("found")


def best_trials(tried: DataFrame, blocks: DataFrame, thresholds: list[float], trials: int) -> DataFrame:
    """photo_id, candidate, method, place, threshold, params, count: the sample with most inliers, then least error, of every candidate, method and threshold.

    The last place (no threshold) has the sample of least squared error over all pairs.
    """
    limits = [*thresholds, float("inf")]

    def run(c, pairs):
        d = distances(c["params"], pairs)
        inside = [d <= t for t in limits]
        return np.column_stack([i.sum(1) for i in inside] + [np.where(i, d * d, 0).sum(1) for i in inside])

    parted = stored(tried.withColumn("part", ((F.col("candidate") * len(METHODS) + F.col("method")) * trials + F.col("trial")).cast("int")))
    got = parted.join(over_pairs(parted, blocks, ["params"], 2 * len(limits), run), ["photo_id", "part"])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("threshold"), F.col("found")[i].alias("count"), F.col("found")[i + len(limits)].alias("squares")) for i, t in enumerate(limits)]))
    flat = got.select("photo_id", "candidate", "method", "trial", "params", each.alias("e")).select("*", "e.*")
    order = F.struct("count", -F.try_divide(F.col("squares"), F.col("count")), -F.col("trial"))
    found = flat.where("count >= 3").groupBy("photo_id", "candidate", "method", "place", "threshold").agg(F.max_by("params", order).alias("params"), F.max("count").alias("count"), F.min_by("squares", -F.col("count")).alias("squares"))
    out = stored(found)
    release(parted)
    return out


def calibrations(photos: DataFrame, direct: DataFrame, blocks: DataFrame) -> DataFrame:
    """photo_id, candidate, intrinsics, params: focal length (six pairs or more), and with it k1 (eight or more), fitted to all pairs from the best guess.

    A focal length outside 0.15 to 10 image sides falls back to the assumed field of view's, k1 beyond 1.5 to none.
    """
    best = direct.groupBy("photo_id").agg(F.min_by("params", F.struct("squares", "candidate", "method")).alias("params"))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(7 + i).alias("free"), F.lit(6 + 2 * i).alias("least")) for i in (0, 1)]))
    rows = best.join(photos, "photo_id").select("photo_id", "params", "pairs", "width", "height", "degrees", kinds.alias("k")).select("*", "k.*").where("pairs >= least")
    start = rows.select("photo_id", "part", "free", "width", "height", "degrees", "params", F.col("params").alias("chosen"), F.lit(float("inf")).alias("threshold"))
    done = fitted(start, blocks)
    wide = F.col("width") / (2 * F.tan(F.radians(F.least(F.lit(150.0), F.greatest(F.lit(10.0), F.coalesce("degrees", F.lit(60.0))))) / 2))
    bend = F.when(F.abs(F.col("params")[K1]) <= 1.5, F.col("params")[K1]).otherwise(0.0)
    flat = camera_of(sane_focal(F.col("params")[FOCAL], "width", "height", wide))
    params = F.concat(F.slice(flat, 1, K1), F.array(bend), F.slice(flat, K1 + 2, 4))
    name = F.when(F.col("part") == 0, "calibrated_focal").otherwise("calibrated_focal_k1")
    out = stored(done.select("photo_id", F.col("part").alias("candidate"), name.alias("intrinsics"), params.alias("params")))
    release(done)
    return out


def _shown(solved: DataFrame) -> DataFrame:
    p, r = F.col("params"), lambda i: F.col("params")[i]
    centre = F.when(p.isNotNull(), F.array(*[-(r(i) * r(9) + r(3 + i) * r(10) + r(6 + i) * r(11)) for i in range(3)]))
    parts = {"rotation": F.slice(p, 1, 9), "translation": F.slice(p, 10, 3), "focal": r(FOCAL), "principal": F.slice(p, 14, 2), "distortion": F.slice(p, 16, 5), "centre": centre}
    return solved.select("photo_id", "pairs", "message", "intrinsics", "method", "mode", F.when(F.col("threshold") < float("inf"), F.col("threshold")).alias("threshold"), *[c.alias(n) for n, c in parts.items()], "inliers", "rmse", "mean_error", "max_error", "params", "chosen")


def poses(photos: DataFrame, pairs: DataFrame, *, threshold: float = 20.0, trials: int = 100) -> DataFrame:
    """One row a photo: its pose of most inliers, then least error over them, among all intrinsics, methods and thresholds; all pairs count where no sample
    has three inliers. rotation (by rows), translation, focal, principal, distortion (five), centre, inliers, rmse, mean_error, max_error, or a message.
    """
    pairs = stored(pairs.select("photo_id", "pair_id", *PAIR))  # read three times
    known = stored(checked(photos.select("photo_id", "width", "height", "focal", "degrees"), pairs))
    fit = known.where("message is null")
    own = placed(fit, pairs)
    blocks, drawn = packed(own), stored(samples(fit, own, trials))
    limits = sorted({float(threshold), *THRESHOLDS})
    first = stored(guesses(fit))
    guessed = best_trials(hypotheses(first, drawn), blocks, limits, trials)
    more = calibrations(fit, guessed.where(F.col("threshold") == float("inf")).join(fit.where("focal is null").select("photo_id"), "photo_id"), blocks)
    calibrated = best_trials(hypotheses(more, drawn), blocks, limits, trials)
    found = guessed.unionByName(calibrated)
    robust = found.where((F.col("threshold") < float("inf")) & (F.col("count") >= 4))
    direct = found.where(F.col("threshold") == float("inf")).join(robust.select("photo_id").distinct(), "photo_id", "left_anti")
    part = ((F.col("candidate") * len(METHODS) + F.col("method")) * (len(limits) + 1) + F.col("place")).cast("int")
    tied = robust.unionByName(direct)  # a refit leaves the inliers as they are, so only attempts with the photo's most need one
    tied = tied.join(tied.groupBy("photo_id").agg(F.max("count").alias("count")), ["photo_id", "count"])
    # thresholds that take the same pose with the same number of inliers take the same inliers
    same = tied.withColumn("part", part).groupBy("photo_id", "candidate", "params", "count").agg(F.min(F.struct("part", "method", "threshold")).alias("s"))
    start = same.select("photo_id", "candidate", "params", "s.*", F.col("params").alias("chosen"), F.lit(6).alias("free"))
    done = fitted(start, blocks)
    scored = measured(done, blocks).where("inliers >= 3")
    whole = F.struct(*[c for c in scored.columns if c != "photo_id"])
    best = scored.groupBy("photo_id").agg(F.max_by(whole, F.struct("inliers", -F.col("rmse"), -F.col("part"))).alias("b")).select("photo_id", "b.*")
    named = best.join(first.unionByName(more).select("photo_id", "candidate", "intrinsics"), ["photo_id", "candidate"])
    named = named.withColumns({"method": F.element_at(F.array(*map(F.lit, METHODS)), F.col("method") + 1), "mode": F.when(F.col("threshold") < float("inf"), "samples").otherwise("direct")})
    out = known.select("photo_id", "pairs", "message").join(named, "photo_id", "left")
    kept = stored(out.withColumn("message", F.coalesce("message", F.when(F.col("params").isNull(), "no pose explains the pairs"))))
    release(pairs, known, own, blocks, drawn, first, guessed, more, calibrated, done)
    return _shown(kept)


def refined(cameras: DataFrame, pairs: DataFrame) -> DataFrame:
    """Poses of ``cameras`` (photo_id, params) refitted to all their pairs, four or more, with the intrinsics kept."""
    known = stored(checked(cameras.select("photo_id", "params"), pairs))
    fit = known.where("message is null")
    own = placed(fit, pairs)
    blocks = packed(own)
    start = fit.select("photo_id", F.lit(0).alias("part"), "params", F.col("params").alias("chosen"), F.lit(float("inf")).alias("threshold"), F.lit(6).alias("free"))
    fits = fitted(start, blocks)
    done = measured(fits, blocks)
    names = {"intrinsics": F.lit("fixed_from_prior"), "method": F.lit("refine"), "mode": F.lit("fixed_intrinsic_refine")}
    kept = stored(known.drop("params").join(done, "photo_id", "left").withColumns(names))
    release(known, own, blocks, fits)
    return _shown(kept)


def pair_errors(solved: DataFrame, pairs: DataFrame) -> DataFrame:
    """photo_id, pair_id, error (pixels), inlier: every pair of the photos with a pose, under the rows of ``poses`` or ``refined``."""
    kind, key = pairs.schema["photo_id"].dataType.simpleString(), pairs.schema["pair_id"].dataType.simpleString()
    # the threshold of a fit over all pairs is null
    cameras = solved.where("params is not null").select("photo_id", "params", "chosen", F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"))

    def run(frames):
        for f in frames:
            if len(f):
                p, c = np.stack(f["params"].to_list()), np.stack(f["chosen"].to_list())
                v = f[list(PAIR)].to_numpy(float)[:, None, :]
                yield pd.DataFrame({"photo_id": f["photo_id"], "pair_id": f["pair_id"], "error": distances(p, v)[:, 0], "inlier": distances(c, v)[:, 0] <= f["threshold"].to_numpy()})

    rows = pairs.select("photo_id", "pair_id", *[F.col(c).cast("double") for c in PAIR]).join(cameras, "photo_id")
    return rows.mapInPandas(run, f"photo_id {kind}, pair_id {key}, error double, inlier boolean")


# ---- one photo


def projected(world: np.ndarray, p: np.ndarray, centre: tuple[float, float], distortion: list[float]) -> np.ndarray:
    """Pixels for rotation vector, translation and focal length."""
    full = np.concatenate((turn_of(p[:3]).ravel(), p[3:7], centre, five(distortion)))[None]
    return residuals(full, np.column_stack((world, np.zeros((len(world), 2))))[None])[0][0]


def _pairs(spark: SparkSession, world, pixels) -> DataFrame:
    world, pixels = np.array(world, float), np.array(pixels, float)
    if len(world) != len(pixels):
        raise ValueError("each pixel needs its point")
    rows = [(0, i, *map(float, w), *map(float, p)) for i, (w, p) in enumerate(zip(world, pixels, strict=True))]
    return spark.createDataFrame(rows, "photo_id int, pair_id int, " + ", ".join(f"{c} double" for c in PAIR))


def solve(spark: SparkSession, world, pixels, width: int, height: int, *, focal: float | None = None, degrees: float = 60.0, threshold: float = 20.0, trials: int = 100) -> dict:
    """The pose of one photo from six pairs or more; see ``poses``."""
    pairs = _pairs(spark, world, pixels)
    if len(world) < 6:
        raise ValueError("six pairs of finite points at least are needed")
    photo = spark.createDataFrame([(0, float(width), float(height), focal, float(degrees))], "photo_id int, width double, height double, focal double, degrees double")
    solved = poses(photo, pairs, threshold=threshold, trials=trials)
    got = solved.first()
    if got.message:
        raise ValueError(got.message)
    inside = [r.inlier for r in pair_errors(solved, pairs).orderBy("pair_id").collect()]
    return _as_pose(got) | {"inliers": inside, "mean_error": got.mean_error, "max_error": got.max_error}


def _as_pose(got) -> dict:
    f, (cx, cy) = got.focal, got.principal
    return {"camera_matrix": [[f, 0, cx], [0, f, cy], [0, 0, 1]], "rotation": np.reshape(got.rotation, (3, 3)).tolist(), "translation": list(got.translation), "distortion": list(got.distortion), "rmse": got.rmse}


def refine(pose: dict, world, pixels) -> dict:
    """Rotation and translation of one photo refitted to four pairs or more, with the intrinsics kept."""
    spark, k = SparkSession.active(), pose["camera_matrix"]
    params = [*[float(x) for r in pose["rotation"] for x in r], *map(float, pose["translation"]), float(k[0][0]), float(k[0][2]), float(k[1][2]), *five(pose.get("distortion"))]
    got = refined(spark.createDataFrame([(0, params)], "photo_id int, params array<double>"), _pairs(spark, world, pixels)).first()
    if got.message:
        raise ValueError(got.message)
    return {**pose, "rotation": np.reshape(got.rotation, (3, 3)).tolist(), "translation": list(got.translation), "rmse": got.rmse}


def pose_row(spark: SparkSession, pose: dict) -> DataFrame:
    flat = lambda m: [float(x) for r in m for x in r]
    return spark.createDataFrame([(flat(pose["camera_matrix"]), flat(pose["rotation"]), list(map(float, pose["translation"])), float(pose["rmse"]), int(sum(pose["inliers"])))], "camera_matrix array<double>, rotation array<double>, translation array<double>, rmse double, inliers int")
