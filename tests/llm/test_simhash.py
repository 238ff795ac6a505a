import random
import re

import pytest
import xxhash
from conftest import DOCS, SF

from plumbline.llm import graph, simhash


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_print(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    rows = list(prints)
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k, _ in rows}


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    groups = brute_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, SF).collect()}
    assert got == {k: (f"{p:016x}", groups[k]) for k, p in prints}


@pytest.mark.parametrize("crowd", [0, 3, 1000])
def test_links_of_crowded_fingerprints(spark, crowd):
    """Balls around a few centres, chains included: every link is kept, none is invented."""
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            y = x
            for _ in range(rng.randint(0, 4)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
    rows = sorted(prints)
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(rows)]
    frame = spark.createDataFrame([(p,) for _, p in signed], "fp long")
    links = simhash.near_links(frame, crowd=crowd)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links.collect())
    got = {r.node: r.root for r in graph.components(links).collect()}
    mine = [(p, p & (1 << 64) - 1) for _, p in signed]
    want = brute_groups(sorted(mine))
    assert {p: got.get(p, p) for p, _ in mine} == want


def test_odd_rows(spark, odd_docs):
    got = simhash.near_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component == 1
    assert by[6].component == 5
    assert simhash.near_groups(odd_docs.limit(0)).count() == 0
    kept = simhash.stage(spark, spark.createDataFrame(odd_docs.select("doc_id", "text", "lang", "source", "n_chars").rdd, DOCS), SF)
    assert {1, 4, 5, 7, 8} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id = 6").count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in graph.components(chain).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_distances_that_are_not_covered(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), distance=3)
