import math
import random

import numpy as np
from conftest import SF

from plumbline.llm import common, pseudolikelihood as pl


def brute(params, codes):
    """Log-probability of each code by plain loops over the network's definition."""
    out = []
    for i, c in enumerate(codes):
        h = params["bias"].astype(float).copy()
        for j, o in enumerate(pl.OFFSETS):
            h += params["embed"][j][codes[i + o] if 0 <= i + o < len(codes) else pl.PAD]
        h = np.tanh(h)
        total = 0.0
        for logits, want in ((h @ params["coarse"] + params["coarse_bias"], c // pl.FINE), (h @ params["fine"] + params["fine_bias"][c // pl.FINE], c % pl.FINE)):
            total += logits[want] - math.log(sum(math.exp(x) for x in logits))
        out.append(total)
    return out


def test_scores_match_definition(spark):
    texts = ["a b a c", "", "b", "a a a a a a a a b c", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    params, top = pl.train(docs)
    codes = pl.Codes(top)
    for r in pl.score(docs, params, top).collect():
        t = (texts[r.doc_id] or "").encode()
        mine = codes(common.Words([t]).prints).tolist()
        assert r.n_tokens == len(mine)
        assert abs(r.log_likelihood - sum(brute(params, mine))) < 1e-3
        assert (r.mean_log_likelihood is None) == (not mine)


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    line = np.concatenate([[pl.PAD] * 3, rng.integers(0, pl.PAD, 40), [pl.PAD] * 3])
    at = np.arange(3, 43)
    p = {k: v.astype(np.float64) for k, v in pl.fresh().items()}
    moved = {k: v.copy() for k, v in p.items()}
    seen = {k: np.zeros_like(v) for k, v in p.items()}
    pl.step(moved, seen, line, at)
    for k in p:
        i = np.unravel_index(int(np.argmax(seen[k])), seen[k].shape)
        eps = 1e-4
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][i] += eps
        down[k][i] -= eps
        slope = -(pl.forward(up, line, at)[3].mean() - pl.forward(down, line, at)[3].mean()) / (2 * eps)
        assert abs(abs(slope) - math.sqrt(seen[k][i])) < 1e-3 * max(1, abs(slope)), k


def test_learns_context(spark):
    """Texts of the corpus score better than the same words shuffled, and better than before training."""
    rng = random.Random(4)
    chain = [f"w{i}" for i in range(30)]
    docs = []
    for i in range(400):
        at = rng.randrange(30)
        docs.append((i, " ".join(chain[(at + j) % 30] for j in range(60))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    params, top = pl.train(frame)
    shuffled = spark.createDataFrame([(i, " ".join(rng.sample(t.split(), 60))) for i, t in docs], "doc_id long, text string")
    mean = lambda f, p: np.mean([r.mean_log_likelihood for r in pl.score(f, p, top).collect()])
    assert mean(frame, params) > mean(shuffled, params) + 0.3
    assert mean(frame, params) > mean(frame, pl.fresh()) + 1


def test_many_parts_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(pl, "FAN_IN", 2)
    docs = spark.createDataFrame([(i, f"a b c d{i % 3}") for i in range(40)], "doc_id long, text string").repartition(7)
    params, top = pl.train(docs, rounds=1)
    assert len(top) == 6 and np.isfinite(params["embed"]).all()


def test_odd_rows(spark, odd_docs):
    params, top = pl.train(odd_docs, rounds=1)
    got = pl.score(odd_docs, params, top).collect()
    assert len(got) == odd_docs.count() and all(r.log_likelihood <= 0 for r in got)
    empty = pl.train(odd_docs.limit(0), rounds=1)
    assert pl.score(odd_docs.limit(0), *empty).count() == 0
    assert pl.score(odd_docs, *empty).count() == odd_docs.count()


def test_query(spark):
    assert pl.op1_pseudolikelihood(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
