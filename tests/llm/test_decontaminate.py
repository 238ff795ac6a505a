import hashlib
import re

from conftest import SF

from plumbline.llm import decontaminate


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for k, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[x]
        out.append((k, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_slices_give_the_same_rows(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = decontaminate.find_contamination(docs, bench)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=str) == want
    monkeypatch.setattr(decontaminate.benchmark_slices, "__defaults__", (2000,))
    parts = decontaminate.find_contamination(docs, bench)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in parts.collect()), key=str) == want


def test_odd_rows(spark, odd_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "TWO, words!"), (4, "déjà vu"), (4, "déjà vu"), (None, "one")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(odd_docs, bench).collect()}
    assert got[7]["items"] == ["3"] and got[7].n_hit == 2
    assert got[8]["items"] == ["4"] and got[8].n_hit == 60
    assert got[1].n_words == got[2].n_words == 0
    assert decontaminate.find_contamination(odd_docs.limit(0), bench).count() == 0
    none = decontaminate.find_contamination(odd_docs, bench.limit(0))
    assert none.count() == odd_docs.count() and none.where("n_hit > 0").count() == 0
    assert decontaminate.sha256_of([]) == hashlib.sha256(b"").hexdigest()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green x blue"), (2, "red " + "x " * 30 + "green blue"), (3, "green blue"), (4, "red")], "doc_id long, text string")
    got = decontaminate.find_near(docs, [("q", "blue red green"), ("r", "green blue")], 6).select("doc_id", "query").distinct().collect()
    assert sorted(map(tuple, got)) == [(1, "q"), (1, "r"), (2, "r"), (3, "r")]


def test_index_holds_every_posting(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").coalesce(1)
    rows = decontaminate.index(docs).collect()
    term_of = {b"a": 0, b"b": 1}
    got = []
    for r in rows:
        block = decontaminate.PositionalBlock(*map(bytes, (r.counts, r.terms, r.sizes, r.steps)), term_of)
        for name, t in term_of.items():
            for p in block.lists.get(t, []):
                d = int(block.begins.searchsorted(p, side="right")) - 1
                got.append((name, r.ids[d], int(p - block.begins[d])))
    assert sorted(got) == [(b"a", 1, 0), (b"a", 1, 2), (b"b", 1, 1), (b"b", 2, 0)]


def test_rows_that_lack_or_share_a_doc_id_stay_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two"), (1, "three one two four"), (None, "five"), (None, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two"), (2, "four")], "item_id long, text string")
    want = [(None, 1, 0), (None, 2, 2), (1, 2, 2), (1, 4, 3)]
    for most in (1 << 20, 3):
        monkeypatch.setattr(decontaminate.benchmark_slices, "__defaults__", (most,))
        got = decontaminate.find_contamination(docs, bench).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit) for r in got), key=str) == sorted(want, key=str)


def test_items_without_id_hit_words(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "none here"), (3, "four five")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two"), ("b", "two three"), ("c", None), (None, "four")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find_contamination(docs, items, window=2).collect()}
    assert got == {1: (3, ["b", None]), 2: (0, []), 3: (1, [None])}
