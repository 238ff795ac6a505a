import numpy as np
from conftest import SF

from plumbline.llm import langid


def test_held_out_accuracy(spark):
    d = f"{SF}/../sf0.01"
    got = langid.op5_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_small_model_by_hand(spark):
    rows = spark.createDataFrame([("en", "the cat the"), ("de", "die katze"), (None, "xx"), ("en", None)], "lang string, text string")
    m = langid.train(rows)
    assert m.langs == ["de", "en"]
    assert np.allclose(m.tables[0]["the"], np.log([0.5 / 3, 2.5 / 4]))
    n, s = m.scores(["the", "zzz", "kat", None, "12 !"])
    assert n.tolist() == [1, 1, 1, 0, 0]
    assert np.allclose(s[0], np.log([0.5 / 3, 2.5 / 4]), atol=1e-6)
    w = " kat "
    grams = {"de": [g for x in (" die ", " katze ") for g in [x]], "en": [" the ", " cat ", " the "]}

    def log(g, lang):
        k = len(g)
        count = sum(x[i : i + k] == g for x in grams[lang] for i in range(len(x)))
        total = sum(max(0, len(x) - k + 1) for x in grams[lang])
        return np.log((count + 0.5) / (total + 1))

    want = []
    for lang in ("de", "en"):
        v = []
        for i in range(len(w) - 1):
            for k in range(min(4, len(w) - i), 0, -1):
                if any(w[i : i + k] in x for xs in grams.values() for x in xs):
                    v.append(log(w[i : i + k], lang))
                    break
        want.append(np.mean(v))
    assert np.allclose(s[2], want, atol=1e-5)


def test_odd_rows(spark, odd_docs):
    m = langid.train(odd_docs)
    got = {r.doc_id: r for r in langid.predict(odd_docs, m).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert got[8].lang_pred == "fr" and 0 <= got[8].score <= 1
    nothing = langid.train(odd_docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    assert langid.predict(odd_docs.limit(0), m).count() == 0
