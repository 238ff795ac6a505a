import numpy as np

from plumbline.llm import langid


def test_units_left_out_of_the_model_still_score(spark):
    rows = [("en", "the cat the dog the end of the thing and the rest")] * 40 + [("sw", "habari yako rafiki"), ("sw", "karibu rafiki")]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    texts = ["rafiki yako", "habarika rafikini", "the cat", "rafiki 12 the unseen", None, "rafiki yako"]
    docs = spark.createDataFrame([(None if i == 5 else 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    small, full = langid.train(labelled, words=2, grams=3), langid.train(labelled)
    assert len(small.rows_of[0]) == 2 and any(small.cut) and not any(full.cut)

    def got(model):
        return sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, model).collect())

    assert got(small) == got(full)
    assert ("None", "sw") in [x[:2] for x in got(small)]
    n, s = full.scores(texts)
    assert n.tolist() == [2, 2, 2, 3, 0, 2] and np.isfinite(s).all()


def test_rare_words_count_as_unseen(spark):
    """Below ``least`` a word is scored by its n-grams, wherever the units are looked up."""
    rows = [("en", "the cat the")] * 3 + [("de", "die katze rar")]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    model, small = langid.train(labelled, least=2), langid.train(labelled, words=1, grams=2, least=2)
    assert set(model.rows_of[0]) == {"the", "cat"} and " rar" in model.rows_of[4]
    docs = spark.createDataFrame([(1, "rar the katze"), (2, "cat rar"), (3, "zzz")], "doc_id long, text string")
    got = [sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, m).collect()) for m in (model, small)]
    assert got[0] == got[1]
