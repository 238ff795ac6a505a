"""Substring dedup with a compressed FM-index per shard.

Text around possibly repeated word windows (see ``anchors``) is spread over shards by its anchor. A shard sorts
its suffixes as far as a window reaches, keeps their Burrows-Wheeler transform as a wavelet matrix of packed bits with
sampled ranks, and streams its texts through it: backward search takes the words from right to left,
one step a word for all texts at once, and the matching statistics say when a whole window
matches. Its suffix interval holds every occurrence; the window is removed if one of them is earlier.
After a match the interval is widened to its parent one word shorter, so no search starts anew.

Edge cases: null, empty and short texts lose nothing; a null doc_id comes before all others; rows that repeat a doc_id
with other texts are documents in the order of a digest of their texts, and rows that repeat doc_id and text count as one
(none is earlier than the other); an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import anchors, common

WINDOW = 20
GRAM = 6


class PackedBits:
    """Bits with ranks: one count for each 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """A sequence over 0..sigma-1 as one bit vector a level, answering how often a symbol stands before a place."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (values >> shift & 1).astype(bool)
            self.levels.append((shift, PackedBits(bits)))
            values = np.concatenate((values[~bits], values[bits]))
        symbols = np.arange(sigma)
        self.begins = self._descend(symbols, np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank(at)
            at = np.where(symbols >> shift & 1, bits.zeros + ones, at - ones)
        return at

    def count(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbols, at) - self.begins[symbols]


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


class FMIndex:
    """An index of texts (symbol 0 ends each), for patterns of at most ``depth`` symbols."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.n = len(text)
        ranks, reach = {1: text}, 1
        while reach < depth:
            ranks[2 * reach] = _paired(ranks[reach], _shifted(ranks[reach], reach))
            reach *= 2
        self.order = np.argsort(ranks[reach], kind="stable")  # suffixes by their first ``reach`` symbols
        self.bwt = WaveletMatrix(text[self.order - 1], sigma)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        # rows that share depth - 1 symbols: the parents of full matches
        half = max(r for r in ranks if r <= depth - 1)
        group = _paired(ranks[half], _shifted(ranks[half], depth - 1 - half))[self.order] if depth - 1 > half else ranks[half][self.order]
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        number = np.cumsum(np.concatenate(([False], group[1:] != group[:-1])))
        self.parent_low, self.parent_high = edge[number], np.concatenate((edge[1:], [self.n]))[number]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of the matches that have the symbol before them."""
        both = self.less[np.concatenate((symbols, symbols))] + self.bwt.count(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        return both[: len(low)], both[len(low) :]

    def stream(self, text: np.ndarray, ends: np.ndarray, lengths: np.ndarray, depth: int):
        """Matching statistics, up to ``depth``, of indexed texts that end before ``ends``, all at once: yields
        (places, low, high) of the windows that match in full. An indexed text always matches itself, so
        a backward step never comes out empty."""
        by = np.argsort(-lengths, kind="stable")
        ends, lengths = ends[by], lengths[by]
        low, high, matched = np.zeros(len(ends), np.int64), np.full(len(ends), self.n), np.zeros(len(ends), np.int64)
        for back in range(1, int(lengths[0]) + 1 if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -back, side="right"))
            at = ends[:live] - back
            l, h = self.extend(text[at], low[:live], high[:live])
            low[:live], high[:live] = l, h
            matched[:live] += 1
            full = np.flatnonzero(matched[:live] == depth)
            if len(full):
                yield at[full], low[full].copy(), high[full].copy()
                row = low[full]
                low[full], high[full], matched[full] = self.parent_low[row], self.parent_high[row], depth - 1


def _sortable(key) -> tuple:
    """A key, or a struct of keys, as a tuple that sorts as Spark sorts it, nulls first."""
    return tuple(map(_sortable, key.values())) if isinstance(key, dict) else (key is not None, key)


def earlier_windows(rows: list[dict], window: int = WINDOW) -> list[np.ndarray]:
    """For each body of a shard, which of its windows also start earlier in the shard."""
    words = [r["symbols"].split(b" ") for r in rows]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    ends = begins + lengths
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(lengths.sum())) + 1
    # order of places over the corpus: document, then word
    firsts = [r["first"] for r in rows]
    names = [(_sortable(f["k"]), f["d"]) for f in firsts]
    order = {n: i for i, n in enumerate(sorted(set(names)))}
    doc = np.array([order[n] for n in names], np.int64)
    begin_at = np.array([f["start"] for f in firsts], np.int64)
    place = np.repeat(doc << 36, lengths + 1) + np.repeat(begin_at - begins, lengths + 1) + np.arange(len(text))
    index = FMIndex(text, len(number) + 1, window)
    by_suffix = place[index.order]
    hit = np.zeros(len(text), bool)
    for at, low, high in index.stream(text, ends, lengths, window):
        lows, which = np.unique(low, return_inverse=True)
        highs = np.zeros_like(lows)
        highs[which] = high
        spans = np.column_stack((lows, highs)).ravel()
        earliest = np.minimum.reduceat(np.append(by_suffix, np.iinfo(np.int64).max), spans)[::2]
        hit[at] = earliest[which] < place[at]
    return [hit[b : b + n - window + 1] for b, n in zip(begins.tolist(), lengths.tolist(), strict=True)]


def marked_windows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, str]:
    """(documents as k, d and t, marks, how they join): the windows that also start earlier."""
    rows = anchors.named(docs, key, text)
    search = anchors.Search(rows, anchors.word_block, window, gram, "words")
    found, verdicts = search.verdicts(lambda shard: earlier_windows(shard, window))
    own = F.col("k").eqNullSafe(F.col("first.k")) & (F.col("d") == F.col("first.d")) & (F.col("start") == F.col("first.start"))
    return rows, anchors.marks(search, found, verdicts, F.when(own, F.col("mask")).otherwise(F.lit(b""))), "d.d = m.d AND d.k <=> m.k"


def _removal(text: bytes, marks: list[dict] | None, window: int) -> tuple[list[bytes], np.ndarray]:
    words = text.split()
    return words, common.covered(anchors.hit_windows(marks), window, len(words))


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, n_words, n_removed and text (the kept words, one space between)."""

    def work(t, marks):
        words, gone = _removal(t, marks, window)
        return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode()

    kind = docs.schema[key].dataType.simpleString()
    return anchors.apply(*marked_windows(docs, key=key, text=text, window=window, gram=gram), f"k {kind}, n_words long, n_removed long, text string", work, [pa.int64(), pa.int64(), pa.string()]).withColumnRenamed("k", key)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def work(t, marks):
        words, gone = _removal(t, marks, WINDOW)
        kept = b" ".join(words) if not gone.any() else b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
        return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()

    return anchors.apply(*marked_windows(docs), "k long, n_words long, n_removed long, kept_sha256 string", work, [pa.int64(), pa.int64(), pa.string()]).withColumnRenamed("k", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a text of which nothing is left goes, one that lost nothing stays as it is."""
    rows = common.with_digest(docs)
    names = F.struct(F.col("doc_id").alias("k"), F.col(common.DIGEST).alias("d"))
    cut = dedup(rows.select(names.alias("key"), "text"), key="key").where("n_removed > 0").select(F.col("key.k").alias("_plumb_k"), F.col("key.d").alias("_plumb_d"), F.col("text").alias("_plumb_cut")).dropDuplicates(["_plumb_k", "_plumb_d"])
    same = F.col("doc_id").eqNullSafe(F.col("_plumb_k")) & (F.col(common.DIGEST) == F.col("_plumb_d"))
    joined = rows.join(cut.hint("merge"), same, "left").where("_plumb_cut IS NULL OR _plumb_cut != ''")
    lost = F.col("_plumb_cut").isNotNull()
    size = F.when(lost, F.char_length("_plumb_cut").cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns({"text": F.coalesce("_plumb_cut", "text"), "n_chars": size}).select(*map(common.quoted, docs.columns))


#: DuckDB SQL for op3_substring_dedup.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM dup),
words AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS s FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op3_substring_dedup": op3_substring_dedup}
SQL = {"op3_substring_dedup": ORACLE}
