"""Quality rules: statistics of whole texts, and a decision list learned from labelled ones.

Sequential covering: rules for the bad class are grown one at a time on two thirds of the labelled
rows (threshold conditions by FOIL gain), pruned on the other third, and kept while they are precise
there; rows that a rule covers are then set aside. The ordered rules become one Spark conditional
expression over the statistics table, so applying them is a narrow projection.

The list is fitted on at most ``LABELLED_ROWS`` labelled rows, the first by a hash of the key; all
else covers every document. Statistics come from one pass over the texts, a block at a time.

Edge cases: null, empty and blank texts have no words, so they fail the base rules; no or one-sided
labels give an empty list, which keeps what passes the base rules; repeated or contradictory labels
are separate training rows; null labels are left out; repeated documents keep their rows; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

#: Labelled rows that a decision list is fitted on, at most.
LABELLED_ROWS = 20_000
#: Share of covered rows that must be bad, on the rows a rule was grown on and on those it was pruned on.
PRECISION = 0.97
LEAST_COVER = 5

#: Fixed value: the symbol characters.
SYMBOLS = "#*$%&|<>"

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks"]

#: What a condition may test: a statistic, or one divided by another.
FEATURES: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "upper_case": ("n_upper", "n_letters"),
    "digits": ("n_digits", "word_chars"),
    "exclamations": ("n_marks", "n_words"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_DIGIT[0x30:0x3A] = True
_MARK[[0x21, 0x3F]] = True


def equal_words(words: common.Words, a: np.ndarray, b: np.ndarray, long: int = 4096, step: int = 1 << 18) -> np.ndarray:
    """Whether the words at places ``a`` and ``b`` are the same, byte by byte."""
    size = words.ends[a] - words.starts[a]
    same = size == words.ends[b] - words.starts[b]
    for i in np.flatnonzero(same & (size > long)):
        same[i] = np.array_equal(words.buf[words.starts[a[i]] : words.ends[a[i]]], words.buf[words.starts[b[i]] : words.ends[b[i]]])
    short = np.flatnonzero(same & (size <= long))
    part = np.cumsum(size[short]) // step  # about as many bytes at a time
    for i in np.split(short, np.flatnonzero(np.diff(part)) + 1) if len(short) else ():
        first = np.cumsum(size[i]) - size[i]
        within = np.arange(size[i].sum()) - np.repeat(first, size[i])
        differ = words.buf[np.repeat(words.starts[a[i]], size[i]) + within] != words.buf[np.repeat(words.starts[b[i]], size[i]) + within]
        same[i] = np.add.reduceat(differ, first, dtype=np.int64) == 0
    return same


def repeated_words(words: common.Words, n: int = 3) -> np.ndarray:
    """Which words lie in an n-word window that stands twice or more in its text.

    Prints find candidates; equality is that of the words themselves.
    """
    at, prints = words.windows(n)
    if not len(at):
        return common.covered(at, n, len(words.prints))
    keyed = common.mix(prints + common.mix(words.doc[at].astype(np.uint64)))
    order = np.argsort(keyed, kind="stable")
    left = np.flatnonzero(keyed[order][1:] == keyed[order][:-1])
    a, b = at[order[left]], at[order[left + 1]]
    same = words.doc[a] == words.doc[b]
    for k in range(n):
        same[same] = equal_words(words, a[same] + k, b[same] + k)
    again = [a[same], b[same]]
    if not same.all():  # a run of equal prints with different words: its windows are told apart by what they say
        clash = np.isin(keyed[order], keyed[order][left[~same]])
        seen: dict[tuple, list[int]] = {}
        for i in at[order[clash]]:
            said = tuple(words.buf[words.starts[i + k] : words.ends[i + k]].tobytes() for k in range(n))
            seen.setdefault((int(words.doc[i]), *said), []).append(i)
        again += [np.array(v) for v in seen.values() if len(v) > 1]
    return common.covered(np.unique(np.concatenate(again)), n, len(words.prints))


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = common.Words(texts)
    buf, at = words.buf, np.minimum(words.text_at, len(words.buf))

    def in_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[at[1:]] - total[at[:-1]]

    inside = np.zeros(len(buf) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    in_word = np.cumsum(inside[:-1]).astype(bool)
    repeated = np.concatenate(([0], np.cumsum(repeated_words(words))))
    lines = []
    for t in texts:
        filled = [x for x in t.split(b"\n") if x.strip()]
        lines.append((len(filled), len(filled) - len(set(filled))))
    return {
        "n_words": words.counts,
        "word_chars": in_text(in_word & ((buf & 0xC0) != 0x80)),
        "n_symbols": in_text(_SYMBOL[buf]),
        "n_dup_lines": np.array([x[1] for x in lines], np.int64),
        "n_repeat_words": repeated[words.first[1:]] - repeated[words.first[:-1]],
        "n_lines": np.array([x[0] for x in lines], np.int64),
        "n_upper": in_text(_UPPER[buf]),
        "n_letters": in_text(_LETTER[buf]),
        "n_digits": in_text(_DIGIT[buf]),
        "n_marks": in_text(_MARK[buf]),
    }


def statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``STATISTICS`` (long) of every text."""

    def run(batches):
        for b in batches:
            for first, texts in common.text_chunks(b.column(1)):
                got = measure(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), *(pa.array(got[s], pa.int64()) for s in STATISTICS)], ["k", *STATISTICS])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, " + ", ".join(f"{s} long" for s in STATISTICS))
    return found.withColumnRenamed("k", key)


def feature(name: str) -> Column:
    top, below = FEATURES[name]
    return F.col(top).cast("double") if below is None else F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(0.0)


Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold
Rule = list[Condition]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    keep = np.ones(len(next(iter(x.values()))), bool)
    for name, op, at in rule:
        keep &= x[name] <= at if op == "<=" else x[name] > at
    return keep


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of highest FOIL gain over the rows given."""
    best, found, base = 1e-9, None, np.log2(bad.mean())
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] > v[:-1])  # a threshold lies between rows cut and cut + 1
        if not len(cut):
            continue
        for op, p, n in (("<=", b[cut], cut + 1), (">", b[-1] - b[cut], len(v) - cut - 1)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - base), 0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = float(gain[i]), (name, op, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best, found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = PRECISION, least: int = LEAST_COVER, most_rules: int = 32) -> list[Rule]:
    """Sequential covering; rows in the order given, every third one prunes."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and bad[left & ~third].sum() >= least:
        grow, prune = left & ~third, left & third
        rule: Rule = []
        inside = grow.copy()
        while not bad[inside].all() and len(rule) < 6:
            _, c = _best_condition({k: v[inside] for k, v in x.items()}, bad[inside])
            if c is None:
                break
            rule.append(c)
            inside &= _covers([c], x)

        def precise(r: Rule) -> bool:
            hit = left & _covers(r, x)
            return hit.sum() >= least and bad[hit & ~third].mean() >= precision and bool(not (hit & third).any() or bad[hit & third].mean() >= precision)

        def worth(r: Rule) -> float:
            hit = prune & _covers(r, x)
            p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        # pruned from the end, as far as the rule stays precise on both parts
        precise_ones = [rule[:n] for n in range(1, len(rule) + 1) if precise(rule[:n])]
        if not precise_ones:
            break
        rule = max(precise_ones, key=lambda r: (worth(r), -len(r)))
        hit = _covers(rule, x) & left
        rules.append(rule)
        left &= ~hit
    return rules


def fit(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", rows: int = LABELLED_ROWS) -> list[Rule]:
    """A decision list from the statistics of at most ``rows`` labelled documents (label 0: bad)."""
    known = stats.join(labels.select(key, F.col(label).alias("y")).where(F.col("y").isNotNull()), key)
    # a hash threshold first, so that what tasks send for the ordered limit stays near ``rows`` in all
    place, n = F.pmod(F.xxhash64(key), F.lit(1 << 30)), known.count()
    if n > rows:
        known = known.where(place < int(1.25 * rows / n * (1 << 30)))
    sample = known.orderBy(place, key, "y", *STATISTICS).limit(rows)
    table = sample.select("y", *(feature(f).alias(f) for f in FEATURES)).toPandas()
    bad = table["y"].to_numpy() == 0
    if not len(bad) or bad.all() or not bad.any():
        return []
    return learn({f: table[f].to_numpy(np.float64) for f in FEATURES}, bad)


def expression(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: the first rule that covers a row, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        test = F.lit(True)
        for name, op, at in rule:
            test = test & (feature(name) <= F.lit(at) if op == "<=" else feature(name) > F.lit(at))
        out = F.when(test, F.lit(" and ".join(f"{n} {op} {at:.6g}" for n, op, at in rule))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, statistics, base_failed, rule (the first that covers the document) and kept."""
    return judge_statistics(common.materialize(statistics(docs, key=key, text=text), "quality"), labels, key=key, label=label)


def judge_statistics(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``stats`` with base_failed, rule and kept."""
    rules = fit(stats, labels, key=key, label=label)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", expression(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs.select("doc_id", "text"), labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep; every row is judged by its own text."""
    rows = common.with_digest(docs)
    stats = statistics(rows.select(F.struct("doc_id", common.DIGEST).alias("key"), "text"), key="key")
    stats = common.materialize(stats.select("key.*", *[c for c in stats.columns if c != "key"]), "quality")
    judged = judge_statistics(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # joined by doc_id as well, so that copies of one text are dealt over the tasks
    bad = judged.where("not kept").select(F.col("doc_id").alias("_plumb_k"), F.col(common.DIGEST).alias("_plumb_d"))
    same = F.col("doc_id").eqNullSafe(F.col("_plumb_k")) & (F.col(common.DIGEST) == F.col("_plumb_d"))
    return rows.join(bad.hint("merge"), same, "left_anti").select(*map(common.quoted, docs.columns))


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL: dict[str, str] = {}  # the learned verdict has no SQL form; tests compare the statistics with brute force
