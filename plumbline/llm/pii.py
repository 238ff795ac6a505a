"""Personal data by candidates and gradient boosting.

Four patterns with checks give the base spans of a text. Generators of high recall propose further spans, which may overlap: every
run of numbers split and joined in other ways, spelled-out and unusual addresses, colon and bracketed IP addresses. Boosted trees
score each proposal by its format and context, and per kind the least score whose calibrated (isotonic) probability on held-out rows reaches
``SURE`` selects it; a third of the documents is held out for that. Chosen proposals must not overlap base spans or one another; better ones go first.

The trees learn from the corpus itself: in a sample of documents, proposals equal to base spans are positive and all others negative. Base spans
are also written anew (two of them in a row, so that the patterns run over both; without the plus; with other separators; spelled out) in their own context, and the proposal that
fits the new form is positive. No feature tells whether the base found a span. The sample is bounded: about ``DOCUMENTS`` documents and at most ``ROWS``
proposals, the first by a hash. Everything else covers every text, whole.

A kind with fewer than ``LEAST`` positives gets no further spans.

Edge cases: null and empty texts have no spans; positions are code points, end exclusive; very long runs of digits or letters are read in
linear time; repeated documents keep their rows; rows without doc_id are judged like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

#: Sampled documents (about), proposals learned from (at most), and positives of a kind (at least).
DOCUMENTS, ROWS, LEAST = 20_000, 60_000, 20
#: Calibrated probability from which a proposal is chosen.
SURE = 0.9

#: The kinds in their order, and the base patterns.
KINDS = ["email", "ip", "card", "phone"]
#: A run of the address's first part, with or without the rest; possessive, so that a run is read once.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Proposals: runs of numbers and what stands between them, spelled-out addresses, colon and bracketed addresses.
_RUN = re.compile(r"[+(]?[0-9](?:[\x20\u00a0().+/_\u2010-\u2015-]{0,3}[0-9])*+")
_NUMBER = re.compile(r"[+(]{0,2}[0-9]+\)?")
_SPELLED = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\s?[\w-]{1,64}(?:\s?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\s?[\w-]{1,64}){0,4}", re.IGNORECASE)
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Fa-f:])")
_BRACKETED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?\[?\.\]?\s?[0-9]{1,3}){3}(?![0-9.])")
_HAS = re.compile(rb"[0-9@]")
_SPELLS = (b" dot ", b"(at)", b"[at]", b"(dot)", b"[dot]", b"{at}")

#: Words that announce a kind, in the corpus's languages.
CUES = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel|write to", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address|adresse|direcci", re.IGNORECASE),
    "card": re.compile(r"card|karte|carte|tarjeta|visa|credit|kredit", re.IGNORECASE),
    "phone": re.compile(r"phone|tel\b|telefon|t[eé]l[eé]|call|fax|mobil|handy", re.IGNORECASE),
}
_CODE = re.compile(r"[=\"'#$<>{}/\\_]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns that pass their checks, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _EMAIL.finditer(text) if m.group(1)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def proposals(text: str) -> list[Span]:
    """Spans that might be personal data; they overlap. At most 19 windows begin at a number, so a text gives linearly many."""
    found: set[Span] = set()
    for run in _RUN.finditer(text):
        parts = [(m.start(), m.end(), sum("0" <= c <= "9" for c in m.group())) for m in _NUMBER.finditer(text, run.start(), run.end()) if m.end() - m.start() <= 24]
        for i, (start, _, _) in enumerate(parts):
            total, before = 0, start
            for a, b, n in parts[i : i + 19]:
                total += n
                if total > 19 or a - before > 3:
                    break
                before = b
                if 13 <= total:
                    found.add((2, start, b))
                if 7 <= total <= 15:
                    found.add((3, start, b))
    found.update((0, m.start(), m.end()) for m in _SPELLED.finditer(text))
    for pattern in (_COLONS, _BRACKETED):
        found.update((1, m.start(), m.end()) for m in pattern.finditer(text))
    return sorted(found)


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


FEATURES = "kind digits groups longest shortest first last length plus brackets balanced spaces dashes dots others luhn distinct lead left right number_left number_right cue other_cue code letters parts".split()


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    own, before, after = text[a:b], text[max(0, a - 32) : a], text[b : b + 8]
    groups = [len(g) for g in re.findall("[0-9]+", own)] or [0]
    digits = _digits(own)
    cues = [bool(p.search(before)) for p in CUES.values()]
    parts = re.findall("[0-9]+", own)
    return [
        kind,
        len(digits),
        len(groups),
        max(groups),
        min(groups),
        groups[0],
        groups[-1],
        b - a,
        own.count("+") * 2 - own.startswith("+"),
        own.count("(") + own.count(")"),
        own.count("(") == own.count(")"),
        own.count(" "),
        own.count("-"),
        own.count("."),
        sum(not c.isalnum() and c not in " -.()+" for c in own),
        bool(digits) and luhn(digits),
        len(set(digits)),
        int(digits[0]) if digits else -1,
        _class(before[-1:]),
        _class(after[:1]),
        bool(re.search(r"[0-9+(][^\w]{0,2}$", before)),
        bool(re.match(r"[^\w]{0,2}[0-9]", after)),
        cues[kind],
        sum(cues) - cues[kind],
        len(_CODE.findall(before[-12:])),
        sum(c.isalpha() for c in own),
        len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts),
    ]


def _variants(kind: int, own: str, other: str, draw: int) -> Iterator[tuple[str, int, int]]:
    """Other ways to write a span: (written, start and end of the span in it). ``draw`` chooses among them."""
    if other:
        yield f"{own} {other}", 0, len(own)
        yield f"{other} {own}", len(other) + 1, len(other) + 1 + len(own)
    new = own
    if kind == 0:
        name, _, host = own.partition("@")
        new = [f"{name} at {host.replace('.', ' dot ')}", f"{name} [at] {host}", f"{name}(at){host.replace('.', '(dot)')}", f"{name} @ {host}"][draw % 4]
    elif kind == 1:
        new = [own.replace(".", "[.]"), own.replace(".", " . ")][draw % 2]
    elif kind == 2:
        d = _digits(own)
        new = [".", "/", "_", "  "][draw % 4].join(d[i : i + 4] for i in range(0, len(d), 4))
    elif kind == 3:
        new = [own[1:], re.sub(r"^\+[0-9]{1,3}[\x20.-]+", "", own), "00" + own[1:], re.sub(r"[\x20()-]+", ".", own[1:]).strip(".")][draw % 4]
    if new != own:
        yield new, 0, len(new)


def examples(text: str) -> Iterator[tuple[list[float], bool]]:
    """Features and label of a text's proposals, and of those in its base spans' other forms."""
    base = base_spans(text)
    known = set(base)
    for p in proposals(text):
        yield features(text, p), p in known
    for i, (kind, a, b) in enumerate(base):
        own, near = text[a:b], base[(i + 1) % len(base)]
        other = text[near[1] : near[2]] if near != base[i] else ""
        left, right = text[max(0, a - 40) : a], text[b : b + 40]
        for new, x, y in _variants(kind, own, other, int(hashlib.md5(own.encode()).hexdigest()[:8], 16)):
            written, fits = left + new + right, (kind, len(left) + x, len(left) + y)
            whole = (len(left), len(left) + len(new))
            also = (near[0], *((len(left) + len(own) + 1, whole[1]) if x == 0 else (whole[0], whole[0] + len(other)))) if len(new) == len(own) + 1 + len(other) and other else None
            for p in proposals(written):
                if p[1] < whole[1] and p[2] > whole[0] and p != also:
                    yield features(written, p), p == fits


@dataclass
class Trees:
    """Boosted regression trees over binned features, for the log-odds."""

    edges: list[np.ndarray]
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin and value by node

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._score(self.binned(x))

    def _score(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.start)
        for feature, cut, value in self.trees:
            at = np.zeros(len(b), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0) -> Trees:
    """Gradient boosting with second-order leaves; histograms of at most ``bins`` bins a feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1], method="lower")) if len(c) else np.zeros(0) for c in x.T]
    model = Trees(edges, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    b, margin = model.binned(x), np.full(len(y), model.start)
    width, nodes = bins + 1, 2 ** (depth + 1) - 1
    flat = b + np.arange(b.shape[1]) * width
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, value, at = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes), np.zeros(len(y), np.int64)
        open_nodes = [0]
        for level in range(depth + 1):
            following = []
            for node in open_nodes:
                rows = np.flatnonzero(at == node)
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -rate * gs / (hs + 1)
                if level == depth or hs < 2 * least * 0.01 or len(rows) < 2 * least:
                    continue
                cells, size = flat[rows].ravel(), b.shape[1] * width
                each = lambda v: np.bincount(cells, None if v is None else np.repeat(v[rows], b.shape[1]), size).reshape(-1, width).cumsum(axis=1)  # noqa: B023, E731
                gl, hl, nl = each(g), each(h), each(None)
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                best = int(gain.argmax())
                if gain.flat[best] <= 1e-6:
                    continue
                feature[node], cut[node] = divmod(best, width)
                at[rows] = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
                following += [2 * node + 1, 2 * node + 2]
            open_nodes = following
        value[feature >= 0] = 0
        model.trees.append((feature, cut, value))
        margin += value[at]
    return model


def calibrated_cut(score: np.ndarray, y: np.ndarray, sure: float = SURE) -> float:
    """The least score whose isotonic probability reaches ``sure``; infinite where none does."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # positives, rows, least score
    for s, v in zip(score[order], y[order], strict=True):
        if blocks and s == last:  # noqa: F821
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1.0, float(s)])
        last = s  # noqa: F841
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            p, n, _ = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += n
    return next((s for p, n, s in blocks if p / n >= sure), float("inf"))


@dataclass
class Detector:
    trees: Trees | None
    cuts: list[float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Chosen proposals, none of which overlaps a base span or another."""
        if self.trees is None:
            return []
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken])
        tops = np.maximum.accumulate([b for _, b in taken]) if taken else []
        free = [p for p in proposals(text) if self.cuts[p[0]] < float("inf") and not (taken and (i := int(np.searchsorted(starts, p[2]))) and tops[i - 1] > p[1])]
        if not free:
            return []
        score = self.trees.score(np.array([features(text, p) for p in free], np.float64))
        good = [(-s, p[1] - p[2], p) for s, p in zip(score, free, strict=True) if s >= self.cuts[p[0]]]
        used, out = set(), []
        for _, _, p in sorted(good):
            places = range(p[1], p[2])
            if used.isdisjoint(places):
                used.update(places)
                out.append(p)
        return out


def learn(rows: list[tuple[list[float], bool]], held: list[bool]) -> Detector:
    """Trees from the examples that are not held out, thresholds from those that are."""
    held = np.array(held, bool)
    x, y = np.array([r[0] for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], np.float64)
    enough = [y[x[:, 0] == k].sum() >= LEAST for k in range(len(KINDS))]
    if not any(enough):
        return Detector(None, [float("inf")] * len(KINDS))
    trees = boost(x[~held], y[~held])
    score = trees.score(x[held])
    kinds = x[held][:, 0]
    return Detector(trees, [calibrated_cut(score[kinds == k], y[held][kinds == k]) if enough[k] else float("inf") for k in range(len(KINDS))])


def _strings(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Row and text of those texts that may hold a span."""
    for first, texts in common.text_chunks(column):
        for i, t in enumerate(texts, first):
            if _HAS.search(t) or any(s in low for low in [t.lower()] for s in _SPELLS):
                yield i, t.decode("utf-8", "replace")


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> Detector:
    """Learns from about ``DOCUMENTS`` documents, at most ``ROWS`` proposals in them."""
    n = docs.count()
    drawn = F.xxhash64(common.quoted(key).cast("string"), common.quoted(text))
    some = docs.select(drawn.alias("h"), common.quoted(text).alias("t"))
    if n > DOCUMENTS:
        some = some.where(F.pmod("h", F.lit(1 << 40)) < int(DOCUMENTS / n * (1 << 40)))

    def run(batches):
        for b in batches:
            h, got, label, of, held = b.column(0).to_pylist(), [], [], [], []
            for i, t in _strings(b.column(1)):
                for j, (x, y) in enumerate(examples(t)):
                    got.append(x)
                    label.append(y)
                    held.append(h[i] % 3 == 0)
                    of.append(int(hashlib.blake2b(f"{h[i]}:{j}".encode(), digest_size=7).hexdigest(), 16))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(got, pa.list_(pa.float64())), pa.array(label, pa.bool_()), pa.array(held, pa.bool_())], ["h", "x", "y", "held"])

    found = some.mapInArrow(run, "h long, x array<double>, y boolean, held boolean").orderBy("h", "x", "y").limit(ROWS).collect()
    return learn([(r["x"], r["y"]) for r in found], [r["held"] for r in found])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detect(docs: DataFrame, model: Detector, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and added: the spans of every text as ``kind:start:end`` lists, and n_email, n_ip, n_card, n_phone of the base."""

    def run(batches):
        for b in batches:
            base, added, n = [""] * len(b), [""] * len(b), np.zeros((4, len(b)), np.int64)
            every = [""] * len(b)
            for i, t in _strings(b.column(1)):
                spans = base_spans(t)
                more = model.added(t, spans)
                base[i], added[i], every[i] = joined(spans), joined(more), joined(spans + more)
                for k, _, _ in spans:
                    n[k, i] += 1
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, n), *(pa.array(x, pa.string()) for x in (base, added, every))], ["k", *(f"n_{k}" for k in KINDS), "base", "added", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(common.quoted(key).alias("k"), common.quoted(text).alias("t")).mapInArrow(run, f"k {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, added string, spans string")
    return found.withColumnRenamed("k", key)


def redacted(docs: DataFrame, model: Detector, *, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans by that of the first."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text)
            new = b.column(at).to_pylist()
            for i, t in _strings(b.column(at)):
                spans = base_spans(t)
                out, done = [], 0
                for a, k, z in sorted((a, k, z) for k, a, z in spans + model.added(t, spans)):
                    if a >= done:
                        out += [t[done:a], f"[{KINDS[k].upper()}]"]
                    done = max(done, z)
                new[i] = "".join(out) + t[done:]
            yield pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(at).type) if j == at else c for j, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = detect(docs, fit(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "added")


QUERIES = {"op12_pii": op12_pii}
SQL: dict[str, str] = {}  # boosted trees have no SQL form; the base is tested against plain patterns, the trees on held-out forms
