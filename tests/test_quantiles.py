import numpy as np
import pytest

from plumbline.operators import quantiles


@pytest.mark.parametrize("few", [1, 4096])
@pytest.mark.parametrize("share", [0.5, 1.0, 0.98])
def test_matches_numpy(spark, monkeypatch, few, share):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = np.random.default_rng(1)
    groups = [rng.normal(0, 1, 1000), np.repeat([1.0, 2.0], [50, 50]), np.array([3.0]), np.array([1.0, 2.0]), np.exp(rng.normal(0, 8, 333)), np.zeros(90), np.append(np.zeros(500), [1e300, -1e300, 1e-300])]
    df = spark.createDataFrame([(g, float(v)) for g, vs in enumerate(groups) for v in vs] + [(0, None), (99, None)], "g int, v double")
    got = {r.g: (r.n, r.quantile) for r in quantiles.quantiles(df, "v", share, "g").collect()}
    assert sorted(got) == list(range(len(groups)))
    for g, vs in enumerate(groups):
        assert got[g][0] == len(vs) and got[g][1] == pytest.approx(np.quantile(vs, share), rel=1e-12, abs=1e-300)


def test_infinite_and_empty(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, 2.0), (1, 1.0), (2, float("nan")), (2, 0.0), (2, 1.0)], "g int, v double")
    assert {r.g: r.quantile for r in quantiles.quantiles(df, "v", 0.5, "g").collect()} == {1: 2.0, 2: 1.0}
    assert quantiles.quantiles(df.limit(0), "v", 0.5, "g").count() == 0
