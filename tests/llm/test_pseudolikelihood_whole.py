import math
from collections import Counter

import numpy as np
from conftest import SF

from plumbline.llm import common, pseudolikelihood as pl


def test_every_place_is_trained_in_one_round():
    words = common.Words([b"a b c d e f g h " * 50, b"", b"x y z"])
    classes = pl.mask_class(words, pl.ROUNDS)
    assert len(classes) == 403 and set(classes) == set(range(pl.ROUNDS))


def test_a_rare_word_costs_its_share_of_its_code(spark):
    top = common.Words([b"the"]).prints
    texts = ["the common the " + "common " * 30 + " ".join(f"w{i}" for i in range(600)), "common", None, "w7 w7", "neverseen"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    counted = pl.word_counts(docs.where("text != 'neverseen'"))
    params = pl.fresh()
    plain = sorted(r.log_likelihood for r in pl.score(docs, params, top).collect())
    whole = sorted(r.log_likelihood for r in pl.score(docs, params, top, counted=counted).collect())
    n = Counter(w for t in texts if t and t != "neverseen" for w in t.split() if w != "the")
    code = lambda w: int(common.Words([w.encode()]).prints[0]) % pl.SHARED
    total = Counter()
    for w, k in n.items():
        total[code(w)] += k
    cost = lambda w: math.log(n[w] / total[code(w)]) if n[w] else -math.log(total[code(w)] + 1)
    want = sum(cost(w) for t in texts if t for w in t.split() if w != "the")
    assert len(plain) == len(whole) == len(texts)
    assert want < -100 and np.isclose(sum(whole) - sum(plain), want)


def test_held_counts_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    counted = pl.word_counts(docs).cache()
    params, top = pl.fresh(), pl.common_words(counted)[:40]
    got = []
    for held in (0, 200, 1 << 17):
        monkeypatch.setattr(pl, "HELD", held)
        got.append({r.doc_id: (r.n_tokens, round(r.log_likelihood, 6)) for r in pl.score(docs, params, top, counted=counted).collect()})
    assert got[0] == got[1] == got[2]
