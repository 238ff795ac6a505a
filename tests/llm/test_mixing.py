from collections import defaultdict

import numpy as np
from conftest import SF

from plumbline.llm import mixing


def brute_targets(words):
    """words: {source: words}; the contract's resharing, round by round."""
    order = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in words else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(words.values()), set(order)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= 2 * words[s]}
        if not over:
            for s in free:
                target[s] = left * w[s] / total
            break
        for s in over:
            target[s] = 2.0 * words[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_words(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").unionByName(odd_docs.select("doc_id", "text", "source"))
    got = mixing.mix(docs, block=32).collect()
    assert len(got) == docs.count()
    texts = docs.collect()
    words = defaultdict(int)
    for r in texts:
        words[r.source] += len((r.text or "").encode().split())
    targets = brute_targets(words)
    by_target = defaultdict(float)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert sum(p.words for p in r.placements) == r.taken
        by_target[round(r.target, 3)] += r.taken
    for s, t in targets.items():
        same = [x for x in targets.values() if round(x, 3) == round(t, 3)]
        assert abs(by_target[round(t, 3)] - sum(same)) <= len(same), (s, t)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), block=32).collect()))


def test_placements_fill_slots_without_overlap(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50), f"s{i % 4}") for i in range(300)], "doc_id long, text string, source string")
    seen = defaultdict(set)
    for r in mixing.mix(docs, block=16).collect():
        for p in r.placements:
            assert p.start + p.words <= r["size"]
            own = {(r.doc_id, i) for i in range(p.start, p.start + p.words)}
            key = (r.target, r.source_size, p.slot, p.shard)
            assert not own & seen[key]
            seen[key] |= own
    assert max(map(len, seen.values())) <= 16 * 2


def test_permutation_and_shards():
    for n in (1, 2, 3, 17, 100, 1025):
        size, key = np.full(n, n), np.full(n, 77, np.uint64)
        p = mixing.permute(np.arange(n), size, key)
        assert sorted(p.tolist()) == list(range(n))
        assert mixing.permute(p, size, key, inverse=True).tolist() == list(range(n))
    spans = [mixing.shard_range(1000, 7, s, 3, 2) for s in range(7)]
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) == 1000


def test_empty(spark, odd_docs):
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    blank = mixing.mix(odd_docs.where("doc_id < 4")).collect()
    assert len(blank) == 3 and all(r.taken == 0 and r.target == 0 for r in blank)
