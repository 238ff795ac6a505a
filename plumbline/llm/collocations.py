"""Phrase collocations by Suffix-sigma (Berberich and Bedathur, 2013).

Every word starts a suffix of its piece, cut after ``max_n`` words. Tasks add equal suffixes of a block of text first; suffixes are then
shuffled by language and first word and sorted in reverse lexicographic order. There all suffixes of a prefix lie together,
so one stack of open prefixes (for each language in the task) counts every prefix in one pass, and a prefix below the least count is dropped as it closes. The empty prefix of a language
counts its words. Candidates then get the counts of their parts by joins.

A first word with more than one in ``HOT`` suffixes of a bounded sample of texts is spread over ``SPLIT`` tasks by its whole suffixes.
Its short prefixes are then counted in parts, so they are kept at any count and added afterwards. Which words are spread changes no result.

A suffix is one string whose words each end with a space: its prefixes are the string prefixes that end there, so plain byte order keeps them together.

Edge cases: null and empty texts have no words; a null lang counts as ``und``, together with texts whose lang is ``und``; words may hold any
character but those that split; ties are ordered by phrase in UTF-8 bytes; repeated rows count as often as they stand; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import common

MAX_N, LEAST, BEST = 3, 10, 2000
#: A longer phrase with this share (in hundredths) of a candidate's count takes its place.
SHARE = 50
#: Rows of the sample that shows which first words are spread; a word is with one in HOT of its suffixes, over SPLIT tasks.
SAMPLE, HOT, SPLIT = 5_000, 500, 32
#: Bytes of text whose equal suffixes are added before the shuffle.
BLOCK_BYTES = 1 << 23
#: Rows handed to Spark at a time.
ROWS = 1 << 16
#: Tasks that choose a language's best phrases before one task ranks what they chose.
RANKERS = 64

#: Fixed value: what ends a piece; spaces and tabs end a word.
ENDS = ".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_END = np.zeros(256, bool)
_END[list(ENDS.encode())] = True
_GAP = _END.copy()
_GAP[[0x20, 0x09]] = True


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts, each with a space behind it; the last word of each one's piece; each text's number of words."""
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    gap = _GAP[buf]
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # the byte behind a word becomes its space
    first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    last = np.flatnonzero(~gap & np.concatenate((gap[1:], [True])))
    piece = np.searchsorted(np.flatnonzero(_END[buf]), first)
    text_at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(first, text_at), prepend=0)
    buf = np.where(gap, 0x20, buf).astype(np.uint8)[keep]
    offsets = np.concatenate(([0], np.cumsum(last - first + 2))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(buf))
    return words, (np.searchsorted(piece, piece, "right") - 1).astype(np.int32), counts


def _prints(words: pa.Array) -> np.ndarray:
    """A 64-bit print of each word, for dealing only."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    sums = common.prefix_sums(common.byte_prints(np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]))
    return common.span_prints(sums, offsets[:-1], offsets[1:])


def _suffixes(langs: list[str], texts: list[bytes], max_n: int, spread: set[tuple[str, str]]) -> pa.RecordBatch:
    """The suffixes of some texts, equal ones added, as ``suffixes`` gives them."""
    words, last, counts = _words(texts)
    coded = words.dictionary_encode()
    code, known = coded.indices.to_numpy() + np.int32(1), coded.dictionary
    lang = pa.array(langs).dictionary_encode()
    here = np.repeat(lang.indices.to_numpy(), counts)
    size, at = len(known) + 1, np.arange(len(code), dtype=np.int32)

    def following(k: int) -> np.ndarray:
        """The k-th word behind each word of its piece; 0 past the end."""
        out = np.zeros(len(code), np.int32)
        inside = np.flatnonzero(at + np.int32(k) <= last)
        out[inside] = code[inside + k]
        return out

    if len(lang.dictionary) * size**max_n >= 1 << 63:  # too many words for one number
        table = pa.table([pa.array(here), *(pa.array(following(k)) for k in range(max_n))], [f"c{i}" for i in range(max_n + 1)])
        found = table.group_by(table.column_names).aggregate([([], "count_all")])
        parts, n, own = [found.column(f"c{i + 1}").to_numpy() for i in range(max_n)], found.column("count_all").combine_chunks(), found.column("c0").to_numpy()
    else:
        key = here.astype(np.int64)
        for k in range(max_n):
            key *= size
            key += following(k)
        found = pc.value_counts(pa.array(key))
        del key
        n, own, parts = found.field("counts"), found.field("values").to_numpy(), []
        for _ in range(max_n):
            own, c = np.divmod(own, size)
            parts.insert(0, c.astype(np.int32))
        own = own.astype(np.int32)
    spelled = pa.concat_arrays([pa.array([""]), known])
    ends = pc.binary_join_element_wise("\n", lang.dictionary, "")
    text = pc.binary_join_element_wise(*[spelled.take(pa.array(c)) for c in parts], ends.take(pa.array(own)), "")
    prints, of_lang = np.concatenate((np.zeros(1, np.uint64), _prints(known))), _prints(lang.dictionary)
    task = common.mix(prints[parts[0]] + common.mix(of_lang[own]))
    hot = np.zeros(len(task), bool)
    for i, name in enumerate(lang.dictionary.to_pylist()):
        listed = pa.array([w for x, w in spread if x == name], pa.string())
        if len(listed):
            hot |= (own == i) & np.concatenate(([False], pc.is_in(known, listed).to_numpy(zero_copy_only=False)))[parts[0]]
    after = np.zeros(len(task), np.uint64)
    for c in parts[1:]:
        after = common.mix(after + prints[c])
    task = np.where(hot, common.mix(task + after % np.uint64(SPLIT)), task)
    return pa.RecordBatch.from_arrays([text, pa.array((task >> np.uint64(33)).astype(np.int32)), n.cast(pa.int64())], ["suffix", "task", "c"])


def _blocks(batches):
    """(languages, texts) of rows (lang, text), by blocks of about ``BLOCK_BYTES``."""
    langs: list[str] = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for first, part in common.text_chunks(b.column(1)):
            for own, t in zip(b.column(0).slice(first, len(part)).to_pylist(), part, strict=True):
                if texts and size + len(t) > BLOCK_BYTES:
                    yield langs, texts
                    langs, texts, size = [], [], 0
                langs.append(UNKNOWN if own is None else own)
                texts.append(t)
                size += len(t) + 1
    if texts:
        yield langs, texts


def suffixes(docs: DataFrame, max_n: int = MAX_N, spread: frozenset[tuple[str, str]] = frozenset(), *, text: str = "text", lang: str = "lang") -> DataFrame:
    """suffix, task, c: every suffix of every piece, cut after max_n words, with its language behind a line feed, its count in a block of
    text, and a number that is the same for equal languages and first words, but has ``SPLIT`` values for those of ``spread``."""

    def run(batches):
        for langs, texts in _blocks(batches):
            found = _suffixes(langs, texts, max_n, spread)
            for at in range(0, len(found), ROWS):
                yield found.slice(at, ROWS)

    return docs.select(common.quoted(lang).alias("lang"), common.quoted(text).alias("text")).mapInArrow(run, "suffix string, task int, c long")


def word_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """word, c: every word with a space and its language behind a line feed, and its count in a block of text."""

    def run(batches):
        for langs, texts in _blocks(batches):
            found = _suffixes(langs, texts, 1, frozenset())
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(2)], ["word", "c"])

    return docs.select(common.quoted(lang).alias("lang"), common.quoted(text).alias("text")).mapInArrow(run, "word string, c long")


def hot_words(docs: DataFrame, **names: str) -> frozenset[tuple[str, str]]:
    """(lang, word with its space) of the first words to be spread: at most ``HOT``, by a sample of about ``SAMPLE`` rows."""
    rows = docs.count()
    part = docs.sample(min(1.0, SAMPLE / max(rows, 1)), 42) if rows > SAMPLE else docs
    words = common.materialize(word_counts(part, **names).groupBy("word").agg(F.sum("c").alias("c")), "sampled-words")
    total = words.agg(F.sum("c")).first()[0] or 0
    found = [tuple(r["word"].split("\n", 1)) for r in words.where(F.col("c") * HOT > total).select("word").collect()]
    common.release(words)
    return frozenset((lang, word) for word, lang in found)


class Stack:
    """The open prefixes of one language, from the empty one on, each below the next, shorter than max_n words."""

    def __init__(self, lang: str, max_n: int, least: int, spread: frozenset[tuple[str, str]], out: list[tuple]):
        self.lang, self.max_n, self.least, self.out = lang, max_n, least, out
        self.spread = {w for x, w in spread if x == lang}
        self.texts, self.counts = [""], [0]

    def close(self) -> None:
        text, n, k = self.texts.pop(), self.counts.pop(), len(self.texts)
        if n >= self.least or k == 0 or self.spread and (self.texts[1] if k > 1 else text) in self.spread:
            self.out.append((self.lang, text[:-1], k, n))
        if k:
            self.counts[-1] += n

    def add(self, suffix: str, n: int) -> None:
        """Counts a suffix; suffixes come in reverse order, each once."""
        texts = self.texts
        while not suffix.startswith(texts[-1]):
            self.close()
        while len(texts) < self.max_n and (done := len(texts[-1])) < len(suffix):
            texts.append(suffix[: suffix.index(" ", done) + 1])
            self.counts.append(0)
        self.counts[-1] += n
        if n >= self.least and len(suffix) > len(texts[-1]):
            self.out.append((self.lang, suffix[:-1], self.max_n, n))


def counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, **names: str) -> DataFrame:
    """lang, phrase, words, f: every phrase of 1 to max_n words that stands ``least`` times or more, and the number of all words as the
    empty phrase of each language."""
    spread = hot_words(docs, **names)
    tasks = common.narrow_partitions(docs.sparkSession, docs)
    dealt = suffixes(docs, max_n, spread, **names).repartition(tasks, "task").sortWithinPartitions(F.desc("suffix"))

    def run(batches):
        stacks: dict[str, Stack] = {}
        out: list[tuple] = []
        kept, n = None, 0  # the last suffix, which the next batch may repeat

        def count(key: str, n: int) -> None:
            at = key.index("\n")
            lang = key[at + 1 :]
            stack = stacks.get(lang)
            if stack is None:
                stack = stacks[lang] = Stack(lang, max_n, least, spread, out)
            stack.add(key[:at], n)

        def rows() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["lang", "phrase", "words", "f"])
            out.clear()
            return made

        for b in batches:
            suffix, c = b.column(0), b.column(1).to_numpy()
            new = np.ones(len(c), bool)
            new[1:] = pc.not_equal(suffix[1:], suffix[:-1]).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)
            for key, add in zip(suffix.take(pa.array(at)).to_pylist(), np.add.reduceat(c, at).tolist() if len(c) else [], strict=True):
                if key == kept:
                    n += add
                    continue
                if kept is not None:
                    count(kept, n)
                kept, n = key, add
            if len(out) >= 10_000:
                yield rows()
        if kept is not None:
            count(kept, n)
        for stack in stacks.values():
            while stack.texts:
                stack.close()
        yield rows()

    parts = dealt.select("suffix", "c").mapInArrow(run, "lang string, phrase string, words int, f long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def scored(table: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every phrase of two words or more: its worst cut, ties to the shortest first part."""
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("first"), F.array_join(F.slice(words, k + 1, F.col("words") - k), " ").alias("rest")))
    cut = table.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    part = table.where(F.col("words").between(1, max_n - 1)).select("lang", "phrase", "f")
    cut = cut.join(part.toDF("lang", "first", "l"), ["lang", "first"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    worst = cut.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    return worst.select("lang", "phrase", "words", "a", "w.l", "w.r", "w.score")


def longer_counts(table: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """lang, phrase, longest: for phrases of 2 to max_n - 1 words, the largest count of a longer phrase that holds their words."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    held = table.where("words >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
    return held.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, *, max_n: int = MAX_N, least: int = LEAST, best: int = BEST, share: int = SHARE, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to max_n words."""
    table = common.materialize(counts(docs, max_n, least, text=text, lang=lang), "phrase-counts")
    found = scored(table, max_n).join(longer_counts(table, max_n), ["lang", "phrase"], "left")
    found = found.where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKERS))).orderBy(*order)
    near = found.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    total = table.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


#: DuckDB SQL for op13_collocations.
ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
cnt AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
tot AS (SELECT lang, sum(f)::BIGINT AS n FROM cnt WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM cnt WHERE k >= 2 AND f >= 10),
cut AS (SELECT lang, phrase, k, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
        FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
sc AS (SELECT cut.lang, cut.phrase, cut.k, cut.a, cut.j, c1.f AS l, c2.f AS r,
              CAST((1000000::HUGEINT * cut.a * cut.a) // (c1.f::HUGEINT * c2.f) AS BIGINT) AS score
       FROM cut JOIN cnt c1 ON c1.lang = cut.lang AND c1.phrase = cut.x AND c1.k = cut.j JOIN cnt c2 ON c2.lang = cut.lang AND c2.phrase = cut.y AND c2.k = cut.k - cut.j),
worst AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner2 AS (SELECT lang, max(a) AS longest, s AS phrase FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS s FROM cand WHERE k = 3) GROUP BY lang, s),
kept AS (SELECT worst.* FROM worst LEFT JOIN inner2 USING (lang, phrase) WHERE worst.k = 3 OR longest IS NULL OR 100 * longest < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN tot USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op13_collocations": op13_collocations}
SQL = {"op13_collocations": ORACLE}
