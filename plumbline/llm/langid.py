"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; an unseen word falls back to its
character n-grams, the longest known one at each place and shorter ones where none is known. A
text's language has the best mean score; its probability is a softmax over the languages.

Training counts words of all labelled rows given: tasks count their own rows, Spark sums; n-grams are counted from the
distinct words, weighted by their counts. Every word counted is known; a caller may take those counted fewer than ``least`` times
for unseen, whose n-grams are learned all the same.

The model that goes to the tasks keeps the ``WORDS`` commonest words and, for each length, the
``GRAMS`` commonest n-grams (ties by text), so its size has a fixed bound. It only saves lookups: where more units are known, a bitmap
(a bound of 32 MB) tells the tasks which words and n-grams may be among those left out, and words that depend on these are scored
from the full counts by joins. No known word or n-gram is left out of a score. What is joined is rarer than all that the model
keeps, so no key of these joins is hot.

Words are runs of letters in Unicode lower case. Edge cases: a null text, or one without a letter, is
``und`` with score 0; null or empty lang values are not learned; with nothing learned everything is
``und``; ties go to the language first in order; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import anchors, common

WORDS = 500_000
GRAMS = 100_000
LONGEST = 4
#: Distinct tokens that a task holds: training passes its counts on beyond it, prediction starts its table anew.
HELD = 200_000
#: Texts whose tokens are looked up together.
TEXTS = 256
#: How strongly the mean log frequency decides; only the score depends on it.
SHARPNESS = 8.0

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def tokens_of(text: str | None) -> list[str]:
    """White-space tokens in lower case; their words are looked up once for each distinct token."""
    return text.lower().split() if text else []


def words_of(token: str) -> list[str]:
    return [token] if token.isalpha() else _LETTERS.findall(token)


def grams_of(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, unit, n) of the words in columns lang and text."""

    def passed_on(held: dict[str, Counter]):
        rows: list[tuple[str, str, int]] = []
        for lang, tokens in held.items():
            words: Counter = Counter()
            for token, n in tokens.items():
                if token.isalpha():
                    words[token] += n
                else:
                    for w in words_of(token):
                        words[w] += n
            rows += [(lang, w, n) for w, n in words.items()]
        lang, unit, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(unit, pa.string()), pa.array(n, pa.int64())], ["lang", "unit", "n"])

    def run(batches):
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(tokens_of(text))
                if sum(map(len, held.values())) > HELD:
                    yield from passed_on(held)
                    held = {}
        yield from passed_on(held)

    found = labelled.where("lang is not null and lang != '' and text is not null").select("lang", "text").mapInArrow(run, "lang string, unit string, n long")
    return found.groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(kind, lang, unit, n) of the n-grams of k characters (kind k) in ``words`` (lang, unit, n)."""

    def run(batches):
        held: dict[tuple[int, str], Counter] = {}
        for b in batches:
            for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for k in range(1, LONGEST + 1):
                    grams = held.setdefault((k, lang), Counter())
                    for g in grams_of(word, k):
                        grams[g] += n
            if sum(map(len, held.values())) > HELD:
                yield from passed_on(held)
                held = {}
        yield from passed_on(held)

    def passed_on(held):
        for (k, lang), grams in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(grams), pa.int32()), pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["kind", "lang", "unit", "n"])

    return words.mapInArrow(run, "kind int, lang string, unit string, n long").groupBy("kind", "lang", "unit").agg(F.sum("n").alias("n"))


def _print(kind: int, unit: str) -> int:
    return zlib.crc32(f"{kind}{unit}".encode())


class Model:
    """Log frequencies: a row of ``values`` for each unit, one column per language; ``rows_of[kind]`` finds a unit's row."""

    def __init__(self, langs: list[str], totals: np.ndarray, tops: list[tuple[list[str], np.ndarray]], cut: list[bool], more: np.ndarray | None = None):
        """``tops`` has each kind's units and their counts by language; ``cut`` tells whether units of a kind were left
        out, and ``more`` is a bitmap of the prints of these (at least)."""
        self.langs, self.totals, self.cut, self.more = langs, np.asarray(totals), cut, more
        self.rows_of: list[dict[str, int]] = []
        parts, at = [np.empty((0, len(langs)))], 0
        for kind, (units, n) in enumerate(tops):
            self.rows_of.append(dict(zip(units, range(at, at + len(units)), strict=True)))
            parts.append(np.log((n + 0.5) / (self.totals[kind] + 1.0)))
            at += len(units)
        self.values = np.concatenate(parts)

    @property
    def tables(self) -> list[dict[str, np.ndarray]]:
        """Of each kind: unit -> its log frequency by language, to look into a model."""
        return [{unit: self.values[at] for unit, at in found.items()} for found in self.rows_of]

    def left_out(self, kind: int, unit: str) -> bool:
        """Whether a unit that has no row may be known all the same."""
        if not self.cut[kind]:
            return False
        bit = _print(kind, unit) % (len(self.more) * 8)
        return bool(self.more[bit >> 3] >> (bit & 7) & 1)

    def places(self, word: str) -> list[int] | None:
        """The rows a word's score is the mean of: its own, or of each place the longest known n-gram that begins there;
        None if that depends on units left out."""
        known = self.rows_of[0].get(word)
        if known is not None:
            return [known]
        if self.cut[0] and self.left_out(0, word):
            return None
        w, out, rows_of, cut = f" {word} ", [], self.rows_of, self.cut
        for i in range(len(w) - 1):
            for k in range(min(LONGEST, len(w) - i), 0, -1):
                at = rows_of[k].get(w[i : i + k])
                if at is not None:
                    out.append(at)
                    break
                if cut[k] and self.left_out(k, w[i : i + k]):
                    return None
        return out

    def candidates(self, word: str) -> list[tuple[int, int, str, int | None]]:
        """Of an unseen word: (place, length, n-gram, row) of the longest kept n-gram at each place, and of those longer, without a row, that may have been left out."""
        w, out = f" {word} ", []
        for i in range(len(w) - 1):
            for k in range(min(LONGEST, len(w) - i), 0, -1):
                at = self.rows_of[k].get(w[i : i + k])
                if at is not None or self.left_out(k, w[i : i + k]):
                    out.append((i, k, w[i : i + k], at))
                if at is not None:
                    break
        return out

    def token_scores(self, tokens: list[str], rest: dict[str, list[str]] | None = None) -> np.ndarray:
        """Of each token: its words' summed scores by language, and their number. Words that depend on units left out go to ``rest``, if given."""
        out = np.zeros((len(tokens), len(self.langs) + 1))
        rows: list[int] = []
        sizes, owners = [], []
        for i, token in enumerate(tokens):
            for word in words_of(token):
                out[i, -1] += 1
                found = self.places(word)
                if found is None and rest is not None:
                    rest.setdefault(token, []).append(word)
                if found:
                    rows += found
                    sizes.append(len(found))
                    owners.append(i)
        if rows:
            size = np.array(sizes)
            means = np.add.reduceat(self.values[rows], np.cumsum(size) - size) / size[:, None]
            np.add.at(out[:, :-1], owners, means)
        return out

    def sums(self, texts: list[str | None], rest: list[Counter] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(words, summed scores by language) of each text; a distinct token is looked up once. Each text's words that depend on units left out are added to ``rest``, if given."""
        n, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        number: dict[str, int] = {}
        table = np.empty((0, len(self.langs) + 1))
        left: dict[str, list[str]] | None = None if rest is None else {}
        for first in range(0, len(texts), TEXTS):
            part = [Counter(tokens_of(t)) for t in texts[first : first + TEXTS]]
            new = list(dict.fromkeys(x for tokens in part for x in tokens if x not in number))
            if len(number) + len(new) > HELD:
                number, table = {}, table[:0]
                left = None if rest is None else {}
                new = list(dict.fromkeys(x for tokens in part for x in tokens))
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            table = np.concatenate((table, self.token_scores(new, left)))
            for i, tokens in enumerate(part, first):
                if tokens:
                    at = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
                    total = np.fromiter(tokens.values(), np.float64, len(tokens)) @ table[at]
                    n[i] = round(total[-1])
                    out[i] = total[:-1]
                    if left:
                        for token in tokens.keys() & left.keys():
                            for word in left[token]:
                                rest[i][word] += tokens[token]
        return n, out

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words, mean scores by language) of each text, from the units kept."""
        n, out = self.sums(texts)
        return n, out / np.maximum(1, n)[:, None]


class Trained(Model):
    """A model that also has its full counts, as a table; these stay with the driver."""

    counted: DataFrame | None = None

    def kept(self) -> Model:
        out = Model.__new__(Model)
        out.__dict__.update({k: v for k, v in self.__dict__.items() if k != "counted"})
        return out


def train(labelled: DataFrame, *, words: int = WORDS, grams: int = GRAMS, least: int = 1) -> Trained:
    """A model from all rows of ``labelled`` (columns lang and text); it holds at most words + LONGEST * grams units, and the table of all."""
    all_words = common.materialize(word_counts(labelled), "langid-words")
    all_grams = common.materialize(gram_counts(all_words), "langid-grams")
    counted = all_words.select(F.lit(0).alias("kind"), "lang", "unit", "n").unionByName(all_grams)
    langs = sorted(r.lang for r in all_grams.where("kind = 1").select("lang").distinct().toLocalIterator())
    if not langs:
        return Trained([], np.zeros((LONGEST + 1, 0)), [([], np.zeros((0, 0)))] * (LONGEST + 1), [False] * (LONGEST + 1))
    totals = np.zeros((LONGEST + 1, len(langs)))
    for r in counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
        totals[r.kind, langs.index(r.lang)] = r.n
    by = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    units = counted.groupBy("kind", "unit").agg(F.sum("n").alias("all"), *by).where((F.col("kind") > 0) | (F.col("all") >= least))
    units = common.materialize(units, "langid-units")
    size = {r.kind: r["count"] for r in units.groupBy("kind").count().collect()}
    tops, cut = [], []
    for kind in range(LONGEST + 1):
        most = grams if kind else words
        own = units.where(F.col("kind") == kind)
        top = own if size.get(kind, 0) <= most else own.orderBy(F.desc("all"), "unit").limit(most)
        found = top.select("unit", *[f"n{i}" for i in range(len(langs))]).toArrow()
        tops.append((found.column(0).to_pylist(), np.column_stack([found.column(i + 1).to_numpy() for i in range(len(langs))]).astype(np.float64)))
        cut.append(size.get(kind, 0) > most)
    more = None
    if any(cut):
        left = units.where(F.col("kind").isin([k for k, c in enumerate(cut) if c]))
        more = anchors.bitmap_of(left.select(F.crc32(F.concat(F.col("kind").cast("string"), "unit").cast("binary")).alias("p")))
    model = Trained(langs, totals, tops, cut, more)
    model.counted = units
    return model


def _logs(model: Trained, units: DataFrame) -> DataFrame:
    """(kind, unit, v) of known units: v has the log frequency by language."""
    totals = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in model.totals]), F.col("kind") + 1)
    counts = F.array(*[F.col(f"n{i}") for i in range(len(model.langs))])
    return units.select("kind", "unit", F.zip_with(counts, totals, lambda n, total: F.log((n + 0.5) / (total + 1.0))).alias("v"))


def _looked_up(model: Trained, shared, distinct: DataFrame) -> DataFrame:
    """(word, v): the scores by language of distinct words that the model does not keep, from the full counts."""
    counted = _logs(model, model.counted.where("kind = 0")).select(F.col("unit").alias("word"), "v")
    known = distinct.join(counted.hint("merge"), "word")

    def run(batches):
        m = shared.value
        for b in batches:
            rows = [(w, *c) for w in b.column(0).to_pylist() for c in m.candidates(w)]
            word, place, k, unit, at = zip(*rows, strict=True) if rows else ((),) * 5
            v = [None if x is None else m.values[x].tolist() for x in at]
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(place, pa.int32()), pa.array(k, pa.int32()), pa.array(unit, pa.string()), pa.array(v, pa.list_(pa.float64()))], ["word", "place", "kind", "unit", "v"])

    unseen = distinct.join(counted.hint("merge"), "word", "left_anti").mapInArrow(run, "word string, place int, kind int, unit string, v array<double>")
    unseen = common.materialize(unseen, "langid-unseen")
    rare = unseen.where("v is null").drop("v").join(_logs(model, model.counted.where("kind > 0")).hint("merge"), ["kind", "unit"])
    places = unseen.where("v is not null").unionByName(rare).groupBy("word", "place").agg(F.max_by("v", "kind").alias("v"))
    return known.unionByName(places.groupBy("word").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(len(model.langs))]).alias("v")))


def predict(docs: DataFrame, model: Trained, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (0 to 1) of every text."""
    langs, whole = model.langs, not any(model.cut)
    shared = docs.sparkSession.sparkContext.broadcast(model.kept())

    def summed(batches):
        m = shared.value
        for b in batches:
            texts = b.column(2).to_pylist()
            rest = None if whole else [Counter() for _ in texts]
            n, s = m.sums(texts, rest)
            words = [list(c.items()) for c in rest] if rest else [[]] * len(texts)
            kind = pa.map_(pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(s.tolist(), pa.list_(pa.float64())), pa.array(words, kind)], ["row", "k", "n", "s", "rest"])

    def decided(batches):
        for b in batches:
            n = b.column(1).to_numpy()
            s = np.array(b.column(2).to_pylist(), np.float64).reshape(len(n), len(langs)) / np.maximum(1, n)[:, None]
            if not langs:
                n = np.zeros_like(n)
                s = np.zeros((len(n), 1))
            p = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            best = s.argmax(axis=1)
            lang = [langs[best[i]] if n[i] else "und" for i in range(len(n))]
            score = np.where(n > 0, p[np.arange(len(n)), best], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["k", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    sums = numbered.mapInArrow(summed, f"row long, k {kind}, n long, s array<double>, rest map<string,bigint>")
    if not whole:
        sums = common.materialize(sums, "langid-sums")
        pairs = sums.select("row", F.explode("rest").alias("word", "times"))
        looked = common.materialize(_looked_up(model, shared, pairs.select("word").distinct()), "langid-words")
        more = pairs.join(looked.hint("merge"), "word").groupBy("row").agg(F.array(*[F.sum(F.col("v")[i] * F.col("times")) for i in range(len(langs))]).alias("more"))
        added = F.when(F.col("more").isNull(), F.col("s")).otherwise(F.zip_with("s", "more", lambda x, y: x + y))
        sums = sums.drop("rest").join(more.hint("merge"), "row", "left").select("k", "n", added.alias("s"))
    return sums.select("k", "n", "s").mapInArrow(decided, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    """The remainder class that is never learned from; a null key is learned from like other classes."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()).select("lang", "text"))
    return predict(docs.select("doc_id", "text"), model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op5_langid": op5_langid}
SQL: dict[str, str] = {}  # tests check held-out accuracy and compare small cases with hand counts
