import re
from collections import Counter

import duckdb
import pytest
from conftest import SF

from plumbline.llm import collocations as co

DOCS = "text string, lang string"


def brute(rows, max_n=3, least=10, best=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        longest = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        rows = []
        for p, a in cand.items():
            if longest[p] and 100 * longest[p] >= 50 * a:
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(map(tuple, co.collocations(df, **kw).collect()))


def test_matches_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.text, r.lang) for r in docs.collect()])
    mine = sorted(map(tuple, co.op13_collocations(spark, SF).collect()))
    assert len(want) > 50 and mine == want
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(c.sql(co.ORACLE).fetchall()) == want


@pytest.mark.parametrize("max_n", [2, 3, 5])
def test_other_lengths_and_spread_words(spark, monkeypatch, max_n):
    """A first word with most suffixes is dealt over tasks; what it counts is the same."""
    rows = [(f"the a{i % 7} b{i % 3} of the, the the the the. x y z" * (1 + i % 5), "en" if i % 4 else "de") for i in range(120)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    want = brute(rows, max_n, 3)
    assert got(df, max_n=max_n, least=3) == want
    monkeypatch.setattr(co, "HOT", 5)
    monkeypatch.setattr(co, "BLOCK_BYTES", 300)
    assert co.hot_words(df)
    assert got(df, max_n=max_n, least=3) == want
    assert got(df, max_n=max_n, least=3, best=4) == brute(rows, max_n, 3, 4)


def test_odd_texts(spark, monkeypatch):
    long = "Long tail " * 30_000
    rows = [(None, "en"), ("", None), (" \t\n.,;", "en"), ("é\x01 É b\x01 b", None)] + [("A\tb  c. Ab\x0bc d\r x  x", None), ("a b c", "und"), (long, "en")] * 12
    want = brute(rows)
    assert any(r[0] == "und" for r in want)
    df = spark.createDataFrame([(t, x, 1, "q") for t, x in rows], DOCS + ", c int, suffix string")
    assert got(df) == want
    monkeypatch.setattr(co, "SAMPLE", 5)
    assert got(df) == want
    assert got(df.limit(0)) == []
    assert got(spark.createDataFrame([(None, None)], DOCS)) == []


def test_wide_products_are_exact(spark):
    """Products past 64 bits: 1000000 * a * a with a of ten millions."""
    a, l, r = 40_000_003, 50_000_017, 60_000_011
    t = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r)], "lang string, phrase string, words int, f long")
    assert [x.score for x in co.scored(t).collect()] == [1000000 * a * a // (l * r)]


def test_a_block_of_text_takes_little_memory():
    """At most 18 bytes of arrays for each byte of text: places are kept for words and ends of pieces, not for bytes."""
    import tracemalloc

    texts = 16 * [r[0].encode() for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    tracemalloc.start()
    try:
        found = co._suffixes(["en"] * len(texts), texts, 3, frozenset())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) and peak < 18 * sum(map(len, texts))
