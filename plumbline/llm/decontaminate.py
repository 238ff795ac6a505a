"""Benchmark decontamination with a distributed positional inverted index.

``index`` stores the postings of all training tokens: a row for each block of documents, with every term of the block and the
sorted positions at which it stands, as packed arrays. The index is written once to the shared folder; term counts read its term
columns only, and searches read it instead of the texts.

A phrase is found by intersecting the offset-adjusted position lists of its terms, from the rarest term (over the whole
corpus) to the commonest; in a block, only phrases are tried whose rarest term stands there. A proximity match merges the lists of
its terms. A phrase never spans documents, so blocks need no exchange; only term counts, one row per benchmark term and
task, are shuffled. Memory follows a block of ``common.CHUNK_BYTES`` of text (or one longer document) and a slice of the benchmark.

The benchmark goes to the tasks in slices of about ``SLICE_BYTES``; each slice is one pass over
the stored index. Passes' rows are combined by block and number in it, so that a row of documents stays a row
whatever the benchmark's size, also if doc_ids repeat or lack.

Edge cases: null and empty texts have no words; an item without words matches nothing; an item
shorter than the window is one window; repeated items all match; an item without id hits words and counts as one item, but the digest of ids leaves it out; an empty benchmark or corpus gives
zero hits or no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

#: Fixed value: words are runs of digits, letters a-z and every non-ASCII character; A-Z count as a-z.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

WINDOW = 13
#: Benchmark text that one pass over the documents carries to every task.
SLICE_BYTES = 8 << 20


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def packed(values) -> bytes:
    return np.asarray(values, "<i4").tobytes()


def postings(texts: list[bytes]) -> tuple[bytes, bytes, bytes, bytes]:
    """A block's words a text, terms (space-joined), postings a term and positions, each list as steps from the one before.

    Positions count through the block, with a gap of one unused position between texts.
    """
    words = [tokens(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int32, int(counts.sum()))
    place = np.arange(len(at)) + np.repeat(np.arange(len(words)), counts)
    order = np.argsort(at, kind="stable")
    sizes = np.bincount(at, minlength=len(number))
    place = place[order]
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    steps = np.diff(place, prepend=0)
    steps[first] = place[first]
    return packed(counts), b" ".join(number), packed(sizes), packed(steps)


def index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: block, ids, and the packed columns of ``postings``."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for first, texts in common.text_chunks(b.column(1)):
                columns = [pa.array([x], pa.binary()) for x in postings(texts)]
                own = ids.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *columns], ["ids", "counts", "terms", "sizes", "steps"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"ids array<{kind}>, counts binary, terms binary, sizes binary, steps binary")
    return common.materialize(found.withColumn("block", F.monotonically_increasing_id()), "postings")


class PositionalBlock:
    """The postings of one block for the terms asked: for each term number its sorted positions."""

    def __init__(self, counts: bytes, terms: bytes, sizes: bytes, steps: bytes, term_of: dict[bytes, int]):
        self.counts = np.frombuffer(counts, "<i4").astype(np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.counts + 1)))
        known = np.fromiter(map(term_of.get, terms.split(), repeat(-1)), np.int64)
        ends = np.cumsum(np.frombuffer(sizes, "<i4"), dtype=np.int64)
        steps = np.frombuffer(steps, "<i4")
        self.lists: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(known >= 0).tolist():
            self.lists[int(known[i])] = np.cumsum(steps[ends[i - 1] if i else 0 : ends[i]], dtype=np.int64)

    def phrase(self, terms: list[int], rarest: list[int]) -> np.ndarray:
        """Start positions of the phrase; ``rarest`` orders the places of ``terms`` by rarity."""
        starts = None
        for i in rarest:
            found = self.lists.get(terms[i])
            if found is None:
                return np.empty(0, np.int64)
            if starts is None:
                starts = found - i
            else:
                at = np.searchsorted(found, starts + i)
                at[at == len(found)] = 0
                starts = starts[found[at] == starts + i]
            if not len(starts):
                break
        return starts

    def near(self, terms: list[int], rarest: list[int], span: int) -> np.ndarray:
        """Positions of the rarest term around which all terms stand within ``span`` words, in any order."""
        anchor = self.lists.get(terms[rarest[0]], np.empty(0, np.int64))
        text = np.searchsorted(self.begins, anchor, side="right") - 1
        low, high = np.maximum(self.begins[text], anchor - span), np.minimum(self.begins[text + 1] - 2, anchor + span)
        for i in rarest[1:]:
            found = self.lists.get(terms[i])
            if found is None:
                return anchor[:0]
            at = np.searchsorted(found, low)
            keep = (at < len(found)) & (found[np.minimum(at, len(found) - 1)] <= high)
            anchor, low, high = anchor[keep], low[keep], high[keep]
        return anchor


def in_order(items: Iterable[str | None]) -> list[str | None]:
    return sorted(items, key=lambda i: (i is None, i or ""))


def windows_of(items: list[tuple[str, bytes]], n: int) -> tuple[dict[bytes, int], dict[tuple[int, ...], list[str]]]:
    """Term numbers, and each distinct window (as term numbers) with the items that have it."""
    term_of: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        t = [term_of.setdefault(w, len(term_of)) for w in tokens(text)]
        for i in range(max(1, len(t) - n + 1) if t else 0):
            found.setdefault(tuple(t[i : i + n]), set()).add(item)
    return term_of, {w: in_order(i) for w, i in found.items()}


def benchmark_slices(benchmark: DataFrame, item: str, text: str, most: int = SLICE_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in slices of about ``most`` bytes, fetched one partition at a time."""
    part, size = [], 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null").toLocalIterator():
        if part and size + len(row.t) > most:
            yield part
            part, size = [], 0
        part.append((row.i, bytes(row.t)))
        size += len(row.t)
    yield part


def term_counts(found: DataFrame, term_of: dict[bytes, int]) -> dict[int, int]:
    """How often each benchmark term stands in the indexed corpus; one row per term reaches the driver."""

    def run(batches):
        total = np.zeros(len(term_of) + 1, np.int64)
        for b in batches:
            for terms, sizes in zip(common.as_bytes(b.column(0)), common.as_bytes(b.column(1)), strict=True):
                known = np.fromiter(map(term_of.get, terms.split(), repeat(len(term_of))), np.int64)
                total += np.bincount(known, np.frombuffer(sizes, "<i4"), len(total)).astype(np.int64)
        at = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    counted = found.select("terms", "sizes").mapInArrow(run, "term long, n long")
    return {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}


def rarest_first(window: tuple[int, ...], counts: dict[int, int]) -> list[int]:
    return sorted(range(len(window)), key=lambda i: (counts.get(window[i], 0), i))


def _searched(found: DataFrame, term_of: dict[bytes, int], schema: str, work: Callable[[int, pa.Array, PositionalBlock], pa.RecordBatch]) -> DataFrame:
    """``work(block number, ids, postings)`` for every block of an index, a few at a time in memory."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                number, ids, *columns = (b.column(j)[i] for j in range(6))
                yield work(number.as_py(), ids.values, PositionalBlock(*(c.as_buffer().to_pybytes() for c in columns), term_of))

    return found.select("block", "ids", "counts", "terms", "sizes", "steps").mapInArrow(run, schema)


def _hits(found: DataFrame, items: list[tuple[str, bytes]], n: int) -> DataFrame:
    """Per document, by block and number in it: words, the positions hit (as start, length runs) and the items found."""
    term_of, windows = windows_of(items, n)
    counts = term_counts(found, term_of) if windows else {}
    # by the rarest term; a window with a term that the corpus lacks cannot occur
    plan: dict[int, list] = {}
    for w, own in windows.items():
        if all(t in counts for t in w):
            rarest = rarest_first(w, counts)
            plan.setdefault(w[rarest[0]], []).append((w, rarest, own))

    def work(number, ids, block):
        step = np.zeros(int(block.begins[-1]) + 1, np.int32)
        item_sets: dict[int, set[str]] = {}
        for w, rarest, own in (x for t in block.lists.keys() & plan.keys() for x in plan[t]):
            starts = block.phrase(w, rarest)
            if len(starts):
                np.add.at(step, starts, 1)
                np.add.at(step, starts + len(w), -1)
                for d in np.unique(np.searchsorted(block.begins, starts, side="right") - 1).tolist():
                    item_sets.setdefault(d, set()).update(own)
        hit = np.cumsum(step[:-1]) > 0
        before = np.concatenate(([0], np.cumsum(hit)))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
        spans: dict[int, list[dict]] = {}
        for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            d = int(np.searchsorted(block.begins, s, side="right")) - 1
            spans.setdefault(d, []).append({"start": s - int(block.begins[d]), "length": e - s})
        n_hit = before[block.begins[1:]] - before[block.begins[:-1]]
        rows = range(len(ids))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(ids), number)),
                pa.array(np.arange(len(ids))),
                ids,
                pa.array(block.counts, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([spans.get(d, []) for d in rows], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                pa.array([in_order(item_sets.get(d, ())) for d in rows], pa.list_(pa.string())),
            ],
            ["block", "at", "k", "n_words", "n_hit", "spans", "items"],
        )

    kind = found.schema["ids"].dataType.elementType.simpleString()
    return _searched(found, term_of, f"block long, at long, k {kind}, n_words long, n_hit long, spans array<struct<start: long, length: long>>, items array<string>", work)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Exact phrase matches of every benchmark window in every document.

    Returns key, n_words, n_hit, spans (runs of hit words) and items (ids as strings, sorted).
    """
    return search(index(docs, key=key, text=text), benchmark, key=key, item=item, item_text=item_text, window=window)


def search(found: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``find_contamination`` over a stored index."""
    slices = [_hits(found, part, window) for part in benchmark_slices(benchmark, item, item_text)]
    if len(slices) == 1:
        return slices[0].drop("block", "at").withColumnRenamed("k", key)
    both = slices[0]
    for s in slices[1:]:
        both = both.unionByName(s)
    runs = F.flatten(F.collect_list("spans"))
    merged = both.groupBy("block", "at").agg(F.first("k").alias("k"), F.max("n_words").alias("n_words"), runs.alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # union of overlapping runs: walk them in order, keeping the end reached so far
    walked = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
        lambda a, r: F.struct((a["hit"] + F.greatest(F.lit(0).cast("long"), r["start"] + r["length"] - F.greatest(a["end"], r["start"]))).alias("hit"), F.greatest(a["end"], r["start"] + r["length"]).alias("end")),
    )
    return merged.select(F.col("k").alias(key), "n_words", walked["hit"].alias("n_hit"), F.col("runs").alias("spans"), "items")


def find_near(docs: DataFrame, queries: list[tuple[str, str]], span: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Proximity matches: documents in which all terms of a query stand within ``span`` words of its rarest term."""
    term_of: dict[bytes, int] = {}
    asked = [(name, [term_of.setdefault(w, len(term_of)) for w in tokens(q.encode())]) for name, q in queries]
    found = index(docs, key=key, text=text)
    counts = term_counts(found, term_of)
    plan = [(name, w, rarest_first(tuple(w), counts)) for name, w in asked if w]

    def work(number, ids, block):
        rows = [(d, name, int(p - block.begins[d])) for name, w, rarest in plan for p in block.near(w, rarest, span).tolist() for d in [int(np.searchsorted(block.begins, p, side="right")) - 1]]
        return pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["k", "query", "position"])

    kind = docs.schema[key].dataType.simpleString()
    return _searched(found, term_of, f"k {kind}, query string, position long", work).withColumnRenamed("k", key)


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs.select("doc_id", "text"), bench)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; the others stay as they are. Every row is judged by its own text."""
    rows = common.with_digest(docs)
    postings_of = index(rows.select(common.DIGEST, "text"), key=common.DIGEST)
    found = search(postings_of, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=common.DIGEST)
    bad = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(common.DIGEST).distinct()
    bad = common.materialize(bad, "contaminated")
    common.release(postings_of)
    return rows.join(bad.hint("merge"), common.DIGEST, "left_anti").select(*map(common.quoted, docs.columns))


#: DuckDB SQL for op7_decontaminate.
ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM pat),
occ AS (SELECT o.doc_id, o.i, o.k, pat.item_id FROM (
          SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS p
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)) o
        JOIN pat ON pat.k = o.k AND pat.p = o.p),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
SQL = {"op7_decontaminate": ORACLE}
