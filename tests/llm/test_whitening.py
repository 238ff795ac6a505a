import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF

from plumbline.llm import whitening

EMB = "vec_id long, embedding array<float>"


def brute(rows):
    """{size: (n, distinct vectors, sums)} and the rows that stay, in integers of Python."""
    stay = [(k, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return stay, {d: sorted({x for _, x in stay if len(x) == d}) for d in {len(x) for _, x in stay}}


def covariance(fit):
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    return np.array([[float(Fraction(n * sum(x[i] * x[j] for x in fit) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)]), s


def check(got, rows, components=16):
    stay, fits = brute(rows)
    facts = {d: (*covariance(f), f) for d, f in fits.items() if d}
    want = sorted((-1 if k is None else k, c + 1, len(x)) for k, x in stay for c in range(min(components, len(x))))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in got) == [w[:2] for w in want]
    deviation = {}
    for k, x in stay:
        if x:
            s, n = facts[len(x)][1], len(fits[len(x)])
            deviation.setdefault(k, []).append((n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), x))
    for r in got:
        assert (r.n, int(r.deviation_exact)) in {y[:2] for y in deviation[r.vec_id]}
        assert r.deviation == (int(r.deviation_exact) if int(r.deviation_exact) < 1 << 63 else None)
    return deviation, facts


def test_matches_integers_of_python(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = whitening.op11_whitening(spark, SF).collect()
    deviation, facts = check(got, rows)
    (v, s, fit), n = facts[64], len(facts[64][2])
    z = np.zeros((len(rows), 16))
    place = {k: i for i, (k, _) in enumerate(rows)}
    for r in got:
        z[place[r.vec_id], r.component - 1] = r.whitened
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    x = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(deviation[k][0][2], s, strict=True)] for k, _ in rows])
    want = x @ q / np.sqrt(e)
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-6
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[c] for c in range(1, 17)], e / np.trace(v), rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 < got[0].identity_error < 1e-9


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 3, 5)]) for i in range(40)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [nan] * 5), (53, [1.0, inf, 0.0, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (56, [1.0, -2.0]), (57, [0.5, 0.25]), (58, [7.0])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], EMB + ", x string, k int")
    got = whitening.whiten(df).collect()
    check(got, rows)
    lone = [r for r in got if r.vec_id == 58]
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in lone] == [(1, 0, None, None, None)]
    assert all(r.identity_error < 1e-9 for r in got if r.vec_id != 58)
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], EMB)).collect() == []


def test_huge_and_rank_deficient(spark):
    rows = [(1, [3e30, 1.0, 1.0]), (2, [-3e30, 2.0, 2.0]), (3, [1e10, 5.0, 5.0]), (4, [1e10, -5.0, -5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, clip = 4, int(9.0e18)
    x = [[max(-clip, min(clip, math.floor(64 * c))) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        assert int(r.deviation_exact) == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id - 1], s, strict=True))
        assert r.deviation is None
    assert {r.whitened for r in got if r.component == 3} == {None}  # two equal columns: rank 2 at most


def test_ill_scaled_entries_keep_their_covariance(spark):
    """A dimension whose spread is a millionth of its offset: doubles of sums of products would lose it."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(1e6, 0.05, 4)]) for i in range(300)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, facts = check(got, rows)
    e = np.linalg.eigvalsh(facts[4][0])[::-1]
    assert np.allclose([r.explained for r in sorted(got, key=lambda r: (r.vec_id, r.component))[:4]], e / e.sum(), rtol=1e-9)
    assert got[0].identity_error < 1e-9


@pytest.mark.parametrize("bound", [1, 10**6, 10**30, 10**60])
def test_remainders_give_the_integers_back(bound):
    rng = np.random.default_rng(7)
    want = np.array([int(s) * int(a) % (bound + 1) * (-1) ** int(b) for s, a, b in zip(rng.integers(0, 1 << 62, 50), rng.integers(0, 1 << 62, 50), rng.integers(0, 2, 50), strict=True)], object)
    moduli = whitening.primes(2 * bound + 1)
    assert (whitening.remaindered([np.mod(want, p).astype(np.int64) for p in moduli], moduli) == want).all()
