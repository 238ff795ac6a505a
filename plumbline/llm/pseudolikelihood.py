"""Masked pseudo-likelihood: a bidirectional window network scores every token from both its sides.

The network sees the three words before and the three after a place, never the place itself:
position-wise embeddings are summed and squashed, and a two-step softmax gives the word's code (a
coarse part, then a fine part given the coarse one). A document's score is the sum of log
P(word | words around it) over all its words.

The ``KNOWN`` commonest words of the corpus have codes of their own; other words share ``SHARED``
hash codes, so the network's size is fixed. A word with a shared code also costs its share of that code's
words, log(count of the word / count of the code), from the full word counts: tasks hold the counts of at most ``HELD`` of the
commoner ones, all others are looked up in a join, with the same result; a word without a count counts as seen once. Word counts cover every document. Training covers every place of every document: each task runs its rows
through numpy SGD, in each round at the places of one mask class (a hash of place and word deals every place to one of the
rounds), and the tasks' parameters are averaged, weighted by the places seen, in groups
of ``FAN_IN`` until one group is left; this repeats for ``ROUNDS`` rounds. What is gathered thus grows with the
corpus, while the driver only gets the last ``FAN_IN`` parameter sets.

Edge cases: null, empty and blank texts have no tokens and score 0 with a null mean; a one-word text is
predicted from padding; an empty corpus scores with the untrained network; repeated rows keep their rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

SIDE = 3
WIDTH = 24
COARSE = FINE = 48
SHARED = 256
KNOWN = COARSE * FINE - SHARED
ROUNDS = 2
BATCH = 2048
RATE = 0.15
FAN_IN = 16
HELD = 1 << 17
OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]
PAD = COARSE * FINE

Params = dict[str, np.ndarray]


def fresh(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {"embed": small(len(OFFSETS), PAD + 1, WIDTH), "bias": np.zeros(WIDTH, np.float32), "coarse": small(WIDTH, COARSE), "coarse_bias": np.zeros(COARSE, np.float32), "fine": small(WIDTH, FINE), "fine_bias": np.zeros((COARSE, FINE), np.float32)}


def packed(p: Params) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def unpacked(data: bytes) -> Params:
    flat, at, out = np.frombuffer(data, "<f4"), 0, {}
    shape = fresh()
    for k in sorted(shape):
        out[k] = flat[at : at + shape[k].size].reshape(shape[k].shape).copy()
        at += shape[k].size
    return out


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all texts; words as fingerprints."""

    def run(batches):
        for b in batches:
            for _, texts in common.text_chunks(b.column(0), 2 << 20):
                word, n = np.unique(common.Words(texts).prints, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counted: DataFrame) -> np.ndarray:
    """Fingerprints of the commonest words, by count (ties by fingerprint)."""
    top = counted.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    return np.array([r.word for r in top], np.int64).view(np.uint64)


class Codes:
    """Word fingerprints to codes: rank for known words, a hash code for others."""

    def __init__(self, top: np.ndarray):
        self.order = np.argsort(top)
        self.sorted = top[self.order]

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        out = (KNOWN + prints % np.uint64(SHARED)).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, prints), len(self.sorted) - 1)
            hit = self.sorted[at] == prints
            out[hit] = self.order[at[hit]]
        return out


def laid_out(words: common.Words, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """The texts' codes with SIDE paddings around each text, and the places of the words."""
    at = np.arange(len(words.prints)) + SIDE * (words.doc + 1)
    line = np.full(len(words.prints) + SIDE * (len(words.counts) + 1), PAD, np.int64)
    line[at] = codes(words.prints)
    return line, at


def around(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of the embeddings, counted through all offsets, that stand around each place: one row of places an offset."""
    return np.stack([line[at + o] + i * (PAD + 1) for i, o in enumerate(OFFSETS)])


def forward(p: Params, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hidden states, probabilities of coarse and fine parts (one column a place), and the words' log-probabilities.

    Columns are places so that maxima, sums and exponentials run along the memory.
    """
    embed = p["embed"].reshape(-1, WIDTH)
    hidden = np.tile(p["bias"], (len(at), 1))
    for near in around(line, at):
        hidden += np.take(embed, near, axis=0)
    np.tanh(hidden, out=hidden)
    coarse, fine = np.divmod(line[at], FINE)
    rows, found, parts = np.arange(len(at)), np.zeros(len(at)), []
    for weights, bias, own in ((p["coarse"], p["coarse_bias"][:, None], coarse), (p["fine"], np.take(p["fine_bias"].T, coarse, axis=1), fine)):
        part = weights.T @ hidden.T
        part += bias
        part -= part.max(axis=0)
        found += part[own, rows]
        np.exp(part, out=part)
        total = part.sum(axis=0)
        found -= np.log(total)
        part /= total
        parts.append(part)
    return hidden, parts[0], parts[1], found


def step(p: Params, seen: Params, line: np.ndarray, at: np.ndarray) -> None:
    """One Adagrad step on the places given; ``seen`` holds the summed squared gradients."""
    hidden, d_coarse, d_fine, _ = forward(p, line, at)
    coarse, fine = np.divmod(line[at], FINE)
    rows, n = np.arange(len(at)), np.float32(len(at))
    d_coarse[coarse, rows] -= 1
    d_fine[fine, rows] -= 1
    d_hidden = (p["coarse"] @ d_coarse + p["fine"] @ d_fine) * (1 - hidden * hidden).T
    hot = np.zeros((COARSE, len(at)), np.float32)
    hot[coarse, rows] = 1
    grads = {"bias": d_hidden.sum(1), "coarse": (d_coarse @ hidden).T, "coarse_bias": d_coarse.sum(1), "fine": (d_fine @ hidden).T, "fine_bias": hot @ d_fine.T}
    for k, g in grads.items():
        descend(p[k], seen[k], g / n)
    # embeddings of words that do not stand around the places have no gradient: only the others are touched
    near = around(line, at).ravel()
    number = np.zeros(len(OFFSETS) * (PAD + 1), np.int64)
    number[near] = 1
    touched = np.flatnonzero(number)
    number[touched] = np.arange(len(touched))
    near = number[near]
    grad = np.empty((len(touched), WIDTH), np.float32)
    for i, d in enumerate(np.tile(d_hidden.astype(np.float64), (1, len(OFFSETS)))):
        grad[:, i] = np.bincount(near, d, len(touched))
    embed, seen_embed = p["embed"].reshape(-1, WIDTH), seen["embed"].reshape(-1, WIDTH)
    part, part_seen = embed[touched], seen_embed[touched]
    descend(part, part_seen, grad / n)
    embed[touched], seen_embed[touched] = part, part_seen


def descend(p: np.ndarray, seen: np.ndarray, g: np.ndarray) -> None:
    """Adagrad, in place."""
    g = g.astype(np.float32, copy=False)
    seen += g * g
    p -= RATE * g / (np.sqrt(seen) + np.float32(1e-6))


def mask_class(words: common.Words, classes: int) -> np.ndarray:
    """The round that trains each place, by its word and its number in the text."""
    place = np.arange(len(words.prints)) - words.first[words.doc]
    return (common.mix(words.prints + place.astype(np.uint64)) % np.uint64(classes)).astype(np.int64)


def _averaged(frame):
    import pandas as pd

    total = sum(frame["places"])
    mean = None
    for places, data in sorted(zip(frame["places"], frame["params"], strict=True)):
        part = np.frombuffer(data, "<f4").astype(np.float64) * (places / total)
        mean = part if mean is None else mean + part
    return pd.DataFrame({"grp": [int(frame["grp"].iloc[0])], "places": [total], "params": [mean.astype("<f4").tobytes()]})


def train(docs: DataFrame, *, text: str = "text", rounds: int = ROUNDS, counted: DataFrame | None = None) -> tuple[Params, np.ndarray]:
    """(parameters, fingerprints of the known words), learned from every place of every text of ``docs``; ``counted`` has their word counts, if known."""
    spark = docs.sparkSession
    top = common_words(word_counts(docs, text) if counted is None else counted)
    params = fresh()
    for turn in range(rounds):
        start = spark.sparkContext.broadcast((packed(params), top))

        def run(batches, start=start, turn=turn):
            from pyspark import TaskContext

            data, top = start.value
            p, codes, places = unpacked(data), Codes(top), 0
            seen = {k: np.full(v.shape, 0.01 if turn else 1e-4, np.float32) for k, v in p.items()}
            for b in batches:
                for _, texts in common.text_chunks(b.column(0)):
                    words = common.Words(texts)
                    line, at = laid_out(words, codes)
                    at = at[mask_class(words, rounds) == turn]
                    for i in range(0, len(at), BATCH):
                        step(p, seen, line, at[i : i + BATCH])
                    places += len(at)
            if places:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([places], pa.int64()), pa.array([packed(p)], pa.binary())], ["grp", "places", "params"])

        learned = common.materialize(docs.select(F.col(text).alias("t")).mapInArrow(run, "grp long, places long, params binary"), "lm-params")
        while (n := learned.count()) > FAN_IN:
            grouped = learned.withColumn("grp", F.expr(f"grp div {FAN_IN}"))
            learned = common.materialize(grouped.groupBy("grp").applyInPandas(_averaged, "grp long, places long, params binary"), "lm-params")
        if n:
            import pandas as pd

            rows = learned.collect()
            params = unpacked(_averaged(pd.DataFrame({"grp": [0] * n, "places": [r.places for r in rows], "params": [bytes(r.params) for r in rows]}))["params"].iloc[0])
    return params, top


def _held(other: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(words, counts) of the commoner words, sorted by word, and the least step of the log-scaled count that they have; never more than ``HELD``."""
    sizes = other.groupBy(_scale().alias("scale")).count().orderBy(F.desc("scale")).collect()  # a few hundred rows at most
    least, total = float("inf"), 0
    for r in sizes:
        total += r["count"]
        if total > HELD:
            break
        least = float(r["scale"])
    table = other.where(_scale() >= least).select("word", "n").toPandas()
    word, n = table["word"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(np.float64)
    order = np.argsort(word)
    return word[order], n[order], least


def _scale():
    return F.floor(8 * F.log2("n")).cast("double")


def _found(word: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words are held, and where."""
    if not len(held):
        return np.zeros(len(word), bool), np.zeros(len(word), np.int64)
    place = np.minimum(np.searchsorted(held, word), len(held) - 1)
    return held[place] == word, place


def _shared_words(words: common.Words, at: np.ndarray) -> pa.Array:
    """Of each text: its words at the places given, and how often they stand there."""
    doc, word = words.doc[at], words.prints[at]
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]) if len(doc) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(doc)))
    ends = np.cumsum(np.bincount(doc[first], minlength=len(words.counts)))
    return pa.MapArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(word[first].view(np.int64)), pa.array(times, pa.int64()))


def score(docs: DataFrame, params: Params, top: np.ndarray, *, key: str = "doc_id", text: str = "text", counted: DataFrame | None = None) -> DataFrame:
    """key, n_tokens, log_likelihood (summed conditional log-probabilities) and mean_log_likelihood.

    With ``counted``, the word counts of the corpus, probabilities are those of words; without it, of codes.
    """
    spark = docs.sparkSession
    held, held_n, least, code_n = np.empty(0, np.uint64), np.empty(0), 0.0, np.ones(SHARED)
    if counted is not None:
        known = spark.createDataFrame([(int(x),) for x in top.view(np.int64)], "word long")
        other = counted.join(F.broadcast(known), "word", "left_anti")
        code = F.pmod("word", F.lit(SHARED))
        codes = other.groupBy(code.alias("code")).agg(F.sum("n").alias("all"))
        for r in codes.collect():
            code_n[r["code"]] = r["all"]
        held, held_n, least = _held(other)
    shared = spark.sparkContext.broadcast((packed(params), top, held, held_n, code_n))

    def run(batches):
        data, known, held, held_n, code_n = shared.value
        p, codes = unpacked(data), Codes(known)
        for b in batches:
            for first, texts in common.text_chunks(b.column(2)):
                words = common.Words(texts)
                line, at = laid_out(words, codes)
                got = np.concatenate([np.empty(0), *(forward(p, line, at[i : i + BATCH])[3] for i in range(0, len(at), BATCH))])
                total = np.bincount(words.doc, got, len(texts)) if len(got) else np.zeros(len(texts))
                rare = np.flatnonzero(line[at] >= KNOWN)
                word = words.prints[rare]
                hit, place = _found(word, held)
                share = np.log(held_n[place[hit]] / code_n[(word[hit] % np.uint64(SHARED)).astype(np.int64)])
                total = total + np.bincount(words.doc[rare[hit]], share, len(texts))
                own = [b.column(i).slice(first, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words.counts, pa.int64()), pa.array(total, pa.float64()), _shared_words(words, rare[~hit])], ["row", "k", "n_tokens", "log_likelihood", "rest"])

    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    found = numbered.mapInArrow(run, f"row long, k {kind}, n_tokens long, log_likelihood double, rest map<bigint,bigint>")
    if counted is not None:
        # a text's own figures travel with its words, under a word of no occurrence, so the network runs once and nothing is stored between
        own = F.array(F.struct(F.xxhash64("row").alias("key"), F.lit(0).cast("long").alias("value")))
        words = found.select("*", F.explode(F.concat(F.map_entries("rest"), own)).alias("w"))
        head = F.col("w.value") == 0
        pairs = words.select("row", F.col("w.key").alias("word"), F.col("w.value").cast("int").alias("times"), *[F.when(head, F.col(c)).alias(c) for c in ("k", "n_tokens", "log_likelihood")])
        joined = pairs.join(other.where(_scale() < least).hint("merge"), "word", "left").join(F.broadcast(codes), code == F.col("code"), "left")
        unseen = 1.0 / (F.coalesce("all", F.lit(0)) + 1)
        within = F.sum(F.col("times") * F.log(F.coalesce(F.col("n") / F.col("all"), unseen)))
        found = joined.groupBy("row").agg(*[F.max(c).alias(c) for c in ("k", "n_tokens")], (F.max("log_likelihood") + within).alias("log_likelihood"))
    found = found.select(F.col("k").alias(key), "n_tokens", "log_likelihood")
    return found.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op1_pseudolikelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = common.materialize(word_counts(docs), "lm-words")
    return score(docs, *train(docs, counted=counted), counted=counted)


QUERIES = {"op1_pseudolikelihood": op1_pseudolikelihood}
SQL: dict[str, str] = {}  # tests compare with a plain restatement of the network and held-out gains
