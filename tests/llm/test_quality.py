from collections import Counter

import numpy as np
import pytest
from conftest import SF

from plumbline.llm import quality

WS = " \t\n\x0b\x0c\r"


def words(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[1:6]) in [brute(t) for k, t in texts if k == r.doc_id], r


def test_statistics_match_brute_force(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = ["doc_id", *quality.STATISTICS[:5]]
    check(quality.statistics(docs).select(cols).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check(quality.statistics(odd_docs).select(cols).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])


def test_learn_finds_the_conjunction():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.3) | (x["c"] > 0.95)
    rules = quality.learn(x, bad)
    covered = np.zeros(3000, bool)
    for r in rules:
        covered |= quality._covers(r, x)
    assert (covered == bad).mean() > 0.99
    assert quality.learn(x, np.zeros(3000, bool)) == []


def test_rules_agree_with_labels_and_expression(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = quality.judge(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    right = sum((r.quality == 1) == r.kept for r in got) / len(got)
    assert right > 0.95, right
    assert sum(r.kept for r in got if r.quality == 1) / sum(r.quality == 1 for r in got) > 0.99


@pytest.mark.parametrize("n", [0, 3])
def test_empty_tables_and_odd_labels(spark, odd_docs, n):
    none = odd_docs.limit(0)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (8, None, None)][:n], "doc_id long, quality int, toxic int")
    assert quality.judge(none, labels).count() == 0
    out = {r.doc_id: r for r in quality.judge(odd_docs, labels).collect()}
    assert out[5].kept and not out[1].kept and out[1].base_failed
    assert quality.judge(odd_docs, labels).count() == odd_docs.count()


def test_equal_prints_of_different_words_are_no_repeat(monkeypatch):
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    long = "q" * 9000
    texts = [f"x {thue} y x {other} y", f"x {thue} y x {other} y z x {other} y", f"{long} b c {long} b c d", f"{long}r b c {long}s b c d", "a b c d a b c", "", "é ü ö  é\tü ö"]
    want = [brute(t)[4] for t in texts]
    assert want[:2] == [0, 6] and list(quality.measure([t.encode() for t in texts])["n_repeat_words"]) == want
    # all prints alike: the words alone decide
    windows = quality.common.Words.windows
    monkeypatch.setattr(quality.common.Words, "windows", lambda w, n: (windows(w, n)[0], windows(w, n)[1] * np.uint64(0)))
    monkeypatch.setattr(quality.common, "mix", lambda x: x * np.uint64(0))
    assert list(quality.measure([t.encode() for t in texts])["n_repeat_words"]) == want
