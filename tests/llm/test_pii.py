import hashlib
import random
import re
import time

import numpy as np
import pytest
from conftest import DOCS, SF

from plumbline.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 16 <= len(d) <= 19 and luhn(d), 8 <= len(d) <= 15][k]:
                out.append((k, m.start(), m.end()))
    return out


def card(rng, n=16):
    d = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


@pytest.mark.parametrize("alphabet", ["a.@-%", "0123.", "01 -(", "+12 ().-", "a1.@+ (-é", "12.+@ "])
def test_base_spans_are_those_of_the_plain_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == brute(text), text


def test_checks_of_base_spans():
    rng = random.Random(3)
    for n in range(14, 22):
        c = card(rng, n)
        for t in (c, " ".join(c[i : i + 4] for i in range(0, n, 4)), c[:-1] + str((int(c[-1]) + 1) % 10), c + " 1"):
            assert pii.base_spans(f"x {t}.") == brute(f"x {t}.")
    assert [s[0] for s in pii.base_spans("255.255.255.255 256.1.1.1 000255.0.0.1")] == [1, 1]


def check(rows, texts):
    want = {}
    for k, t in texts:
        b = brute(t)
        want.setdefault(k, []).append(([sum(x[0] == n for x in b) for n in range(4)], hashlib.sha256(pii.joined(b).encode()).hexdigest(), set(pii.joined(b).split(",")) - {""}))
    assert len(rows) == len(texts)
    for r in rows:
        own = set(r.spans.split(",")) - {""}
        assert any([r.n_email, r.n_ip, r.n_card, r.n_phone] == n and r.base_sha256 == s and base <= own for n, s, base in want[r.doc_id])
        order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert order == sorted(order)


def test_whole_table(spark):
    sf = f"{SF}/../sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(pii.op12_pii(spark, sf).collect(), docs)


def test_odd_documents(spark, odd_docs):
    model = pii.fit(odd_docs)
    assert model.trees is None
    found = pii.detect(odd_docs, model)
    assert sorted(map(str, [r.doc_id for r in found.collect()])) == sorted(map(str, [r.doc_id for r in odd_docs.collect()]))
    check([r for r in pii.detect(odd_docs, model).selectExpr("*", "sha2(base, 256) AS base_sha256").collect()], [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert pii.detect(odd_docs.limit(0), pii.fit(odd_docs.limit(0))).collect() == []


def corpus(n, seed):
    """Texts with personal data in plain forms, numbers that are none, and words."""
    rng = random.Random(seed)
    words = "the of letter at house green port dot was call in".split()
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 12)))
    kinds = [
        lambda: f"{rng.choice(words)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: card(rng),
        lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(1000):03}) 555-{rng.randrange(10000):04}",
        lambda: "".join(rng.choice("123456789") for _ in range(rng.choice([5, 8, 11, 16, 16]))),
        lambda: f"{rng.randrange(1900, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02} {rng.randrange(24)}:{rng.randrange(60):02}",
        lambda: f"{rng.randrange(300, 999)}.{rng.randrange(300)}.{rng.randrange(300)}.{rng.randrange(300)}",
    ]
    return [" ".join(x for _ in range(rng.randrange(1, 4)) for x in (some(), rng.choice(kinds)(), some())) for _ in range(n)]


def test_trees_find_other_forms_and_leave_clean_texts_alone(spark):
    model = pii.fit(spark.createDataFrame(list(enumerate(corpus(1500, 1))), "doc_id long, text string"))
    rng = random.Random(9)
    hits = total = 0
    for _ in range(200):
        a, b, phone = card(rng), card(rng), f"+1 ({rng.randrange(1000):03}) 555-{rng.randrange(10000):04}"
        for left, right, kind in ((a, b, 2), (phone, ".".join(str(rng.randrange(100, 256)) for _ in range(4)), 3)):
            text = f"the port of {left} {right} was green"
            base = pii.base_spans(text)
            got = model.added(text, base)
            total += 1
            hits += (kind, 12, 12 + len(left)) in base + got
            taken = sorted((x, y) for _, x, y in got)
            assert all(p[1] <= q[0] for p, q in zip(taken, taken[1:], strict=False))
    assert hits > 0.9 * total
    spelled = [f"the letter {rng.choice(['ann', 'bo'])}.{i} at mail{i % 9} dot example dot com was green 1" for i in range(100)]
    assert sum((0, 11, t.index(" was")) in model.added(t, pii.base_spans(t)) for t in spelled) > 80
    clean = [t for t in corpus(3000, 2) if not brute(t)]
    wrong = [t for t in clean if model.added(t, [])]
    assert len(clean) > 500 and len(wrong) <= 0.01 * len(clean), wrong[:5]


def test_boosting_and_calibration():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = pii.boost(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0) == y[3000:]).mean() > 0.97
    s = rng.normal(0, 1, 20_000)
    p = 1 / (1 + np.exp(-4 * s))
    cut = pii.calibrated_cut(s, (rng.random(20_000) < p).astype(float))
    assert abs(1 / (1 + np.exp(-4 * cut)) - 0.9) < 0.05
    assert pii.calibrated_cut(np.zeros(0), np.zeros(0)) == float("inf")


def test_long_runs_take_linear_time():
    began = time.time()
    for t in ("9" * 300_000, "a." * 150_000, "1." * 150_000, "+1(" * 100_000, "1 " * 100_000, "a@" * 150_000, "+1" + "(" * 300_000):
        pii.base_spans(t)
        pii.proposals(t)
    assert time.time() - began < 60


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "écrire à a.b@c.de, +49 (30) 1234-5678!", 1), (2, None, 2), (3, "1.2.3.4", 3)], "doc_id long, text string, k int")
    got = pii.redacted(docs, pii.Detector(None, []))
    assert [tuple(r) for r in got.collect()] == [(1, "écrire à [EMAIL], [PHONE]!", 1), (2, None, 2), (3, "[IP]", 3)]
    assert got.columns == docs.columns and DOCS
