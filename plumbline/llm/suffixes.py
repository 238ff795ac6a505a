"""Suffix-array dedup of bytes by distributed prefix doubling over ranges of positions.

Prefix doubling ranks positions by growing prefixes and drops a position once its rank is unique. As rows, one for each
byte and round, that moves many times the corpus. Here a row is a range of neighbouring positions that share an anchor
(see ``anchors``): the windows that start from ``anchor - hi`` to ``anchor - lo``. What all windows of a range have in
common is its core; the wider the range, the shorter the core.

1. A first range holds all the positions of an anchor; its core are the ``GRAM`` bytes at the anchor. Anchors whose gram stands nowhere
   else drop out before anything but gram counts is shuffled.
2. Each round ranks ranges by their cores, in Spark: a rank is a digest chained from the pair (rank so far, bytes by
   which the core has grown), so equal ranks mean equal cores in every task. Rows are grouped by rank. A range of unique rank
   drops out: none of its windows repeats. Ranges of one rank whose remaining bytes are equal too repeat as a whole; they are
   marked and collapse to one. The others are cut into ``FAN`` narrower ranges at fixed distances from the anchor, whose
   cores are longer.
3. After the last round a range is one position and its core a whole window of 400 bytes: equal ranks repeat.

Cores grow 100, 358, 394, 400. Equal windows have equal anchors at equal distances, so they stay in equal ranges to the end.
Digests have 128 bits (BLAKE2), so equality does not rest on prints that can be made to collide. No group is gathered:
groups are counted with partial sums and joined to their rows, where adaptive execution splits a hot one.

Edge cases: null and empty texts are zero bytes; texts under the window lose nothing; every row is a document of its own,
also if doc_ids repeat or lack; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import anchors, common
from plumbline.llm.anchors import digest

WINDOW = 400
GRAM = 100
FAN = 7

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RANGE = "first long, rank binary, body binary, c int, m int, lo int, hi int, lft binary, rgt binary, known boolean"


def _number(*values: int) -> bytes:
    return b"".join(v.to_bytes(4, "little") for v in values)


def first_ranges(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(d, at, ranges' columns): of each document its anchors whose gram may repeat, equal surroundings in one row.

    ``first`` numbers the rows; ``lft`` and ``rgt`` are the bytes of the range's windows before and after the core; ``body`` is a digest of all.
    """
    bitmap = anchors.repeated_grams(docs, anchors.byte_block, window, gram, "bytes")
    span = window - gram + 1

    def passing(block, names):
        runs = anchors.find_runs(block, window, gram, by_place=True)
        runs = runs[anchors._hits(runs.gram, bitmap.value)]
        raw, rows, places = block.raw, {}, []
        own = block.first[runs.text]
        for text, start, n, a, at in zip(runs.text.tolist(), (runs.start + own).tolist(), runs.windows.tolist(), runs.anchor.tolist(), (runs.anchor - own).tolist(), strict=True):
            lo, hi = a - start - n + 1, a - start
            rank = digest(raw[a : a + gram])
            lft, rgt = raw[start:a], raw[a + gram : start + n - 1 + window]
            body = digest(rank, _number(lo, hi), lft, rgt)
            if (text, body) in rows:  # periodic text
                places[rows[text, body]][1].append(at)
            else:
                rows[text, body] = len(places)
                places.append((text, [at], body, rank, lo, hi, lft, rgt))
        text, at, body, rank, lo, hi, lft, rgt = zip(*places, strict=True) if places else ((),) * 8
        n = len(text)
        columns = [names.column(1).take(pa.array(text, pa.int64())), pa.array(at, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in (rank, body)), *(pa.array(x, pa.int32()) for x in ([0] * n, [span] * n, lo, hi)), pa.array(lft, pa.binary()), pa.array(rgt, pa.binary()), pa.array([False] * n, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["d", "at", *(x.split()[0] for x in own_columns.split(", "))])

    own_columns = RANGE.removeprefix("first long, ")
    found = anchors.blocks(docs, anchors.byte_block, f"d binary, at array<long>, {own_columns}", passing)
    return common.materialize(found.withColumn("first", F.monotonically_increasing_id()), "bytes-ranges")


def cut(ranges: DataFrame, step: int) -> DataFrame:
    """The ranges cut to at most ``step`` positions, with the ranks of their longer cores."""
    names = [x.split()[0] for x in RANGE.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for first, rank, c, m, lo, hi, lft, rgt, known in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                for c2 in range(c, c + m, step):
                    m2 = min(step, c + m - c2)
                    lo2, hi2 = max(lo, c2), min(hi, c2 + m2 - 1)
                    if lo2 > hi2:
                        continue
                    inner, grow = hi - c2, c + m - c2 - m2  # lft[inner:] and rgt[:grow] join the core
                    rank2 = digest(rank, _number(c2), lft[inner:], rgt[:grow])
                    lft2, rgt2 = lft[hi - hi2 : inner], rgt[grow : len(rgt) - (lo2 - lo)]
                    out.append((first, rank2, digest(rank2, _number(lo2, hi2), lft2, rgt2), c2, m2, lo2, hi2, lft2, rgt2, known))
            kinds = [pa.int64()] + [pa.binary()] * 2 + [pa.int32()] * 4 + [pa.binary()] * 2 + [pa.bool_()]
            columns = zip(*out, strict=True) if out else ((),) * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return ranges.select("first", "rank", "c", "m", "lo", "hi", "lft", "rgt", "known").mapInArrow(run, RANGE)


def judged(rows: DataFrame, copies, name: str) -> DataFrame:
    """(body, least, n, go): of each body its least ``first``, its copies, and whether its rank has other bodies of
    which at least one is not known to repeat."""
    bodies = common.materialize(rows.groupBy("rank", "body").agg(F.min("first").alias("least"), copies.alias("n"), F.bool_and("known").alias("known")), f"{name}-bodies")
    ranks = bodies.groupBy("rank").agg(F.count("*").alias("bodies"), F.count(F.when((F.col("n") == 1) & ~F.col("known"), 1)).alias("open"))
    ranks = common.materialize(ranks.where("bodies > 1 AND open > 0").select("rank", F.lit(True).alias("go")), f"{name}-ranks")
    return bodies.join(ranks, "rank", "left").where("n > 1 OR go").select("body", "least", "n", F.coalesce("go", F.lit(False)).alias("go"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, fan: int = FAN, *, written: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(first ranges, hits): hits has (body, lo, hi), the positions of a first range's body whose windows stand elsewhere too.

    ``written`` gets the tables that both depend on."""
    top = first_ranges(docs, window, gram)
    told = common.materialize(judged(top, F.sum(F.size("at")), "bytes-0"), "bytes-0-judged")
    whole = told.where("n > 1").select("body", F.lit(0).alias("lo"), F.lit(window - gram).alias("hi"))
    ranges = _open(top, told.where("go").select("body", F.col("least").alias("first"), (F.col("n") > 1).alias("known")))
    written = [] if written is None else written
    written += [top, told]
    step, turn, hits = window - gram + 1, 0, None
    while step > 1:
        step, turn = -(-step // fan), turn + 1
        rows = common.materialize(cut(ranges, step), f"bytes-{turn}")
        verdicts = judged(rows, F.count("*"), f"bytes-{turn}")
        known = F.col("n") > 1
        found = rows.select("first", "body", "lo", "hi").join(verdicts, "body").select("first", "body", "lo", "hi", known.alias("known"), (F.col("go") & (F.col("first") == F.col("least"))).alias("on"))
        found = common.materialize(found.where("known OR on"), f"bytes-{turn}-judged")
        written += [rows, found]
        part = found.where("known").select("first", "lo", "hi")
        hits = part if hits is None else hits.unionByName(part)
        ranges = _open(rows, found.where("on").select("first", "body", "known"))
    if hits is None:
        return top, whole
    return top, whole.unionByName(hits.join(told.where("go").select("body", F.col("least").alias("first")), "first").select("body", "lo", "hi"))


def _open(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows, one for each body that goes on, with their bytes."""
    return rows.drop("known").join(chosen, ["first", "body"]).select(*(x.split()[0] for x in RANGE.split(", ")))


def marked_ranges(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, str]:
    """(documents as k, d and t, removed spans of their texts as d and marks, how they join). A text's spans are found once, however many
    documents share it."""
    rows = anchors.named(docs, key, text)
    written: list[DataFrame] = []
    top, hits = repeated_ranges(rows, window, gram, written=written)
    spans = common.materialize(hits.groupBy("body").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "bytes-hits")
    places = top.select("d", "body", "at", "lo", "hi").join(spans, "body")
    marks = places.groupBy("d").agg(F.collect_set(F.struct("at", "lo", "hi", "spans")).alias("marks"))

    def merged(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), removed_spans(b.column(1), window)], ["d", "marks"])

    # written before its join, so that the join's two sides are plain shuffles and a text with many copies can be split
    marked = common.materialize(marks.mapInArrow(merged, "d binary, marks array<struct<start:long,end:long>>"), "bytes-marks")
    common.release(spans, *written)
    return rows, marked, "d.d = m.d"


def removed_spans(marks: pa.ListArray, window: int) -> pa.ListArray:
    """Of each text the maximal removed byte runs."""
    each = marks.flatten()
    at, spans, low, high = (each.field(x) for x in ("at", "spans", "lo", "hi"))
    sizes = lambda x: x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(marks)), sizes(marks))
    # each place of a mark with each of its spans
    n, places = sizes(spans), sizes(at)
    m = np.repeat(np.arange(len(each)), n * places)
    i = np.arange(len(m)) - np.repeat(np.cumsum(n * places) - n * places, n * places)
    a = at.flatten().to_numpy()[(np.cumsum(places) - places)[m] + i // n[m]]
    s, span = spans.flatten(), (np.cumsum(n) - n)[m] + i % n[m]
    starts = a - np.minimum(s.field("hi").to_numpy()[span], high.to_numpy()[m])
    ends = a - np.maximum(s.field("lo").to_numpy()[span], low.to_numpy()[m]) + window
    text = text[m]
    order = np.lexsort((starts, text))
    text, starts, ends = text[order], starts[order], ends[order]
    reach = np.maximum.accumulate(ends + (text << 40)) - (text << 40)  # texts are shorter than 2**40 bytes
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (starts[1:] > reach[:-1]))) if len(text) else np.empty(0, bool)
    first = np.flatnonzero(new)
    offsets = np.searchsorted(text[first], np.arange(len(marks) + 1)).astype(np.int32)
    last = np.append(first[1:], len(text))[: len(first)] - 1
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(starts[first], pa.int64()), pa.array(reach[last], pa.int64())], ["start", "end"]))


def _kept(text: bytes, spans: list[dict]) -> bytes:
    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, n_bytes, spans (start, end of each maximal removed run) and kept (the remaining bytes)."""

    def work(t, marks):
        return len(t), marks or [], _kept(t, marks or [])

    kind = docs.schema[key].dataType.simpleString()
    return anchors.apply(*marked_ranges(docs, key=key, text=text, window=window, gram=gram), f"k {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary", work, [pa.int64(), SPANS, pa.binary()]).withColumnRenamed("k", key)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def work(t, marks):
        spans = marks or []
        return len(t), sum(s["end"] - s["start"] for s in spans), len(spans), hashlib.sha256(_kept(t, spans)).hexdigest()

    return anchors.apply(*marked_ranges(docs), "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", work, [pa.int64()] * 3 + [pa.string()]).withColumnRenamed("k", "doc_id")


#: DuckDB SQL for op9_suffix_dedup.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT r, doc_id, b, CAST(octet_length(b) AS BIGINT) AS n FROM d),
win AS (SELECT r, i, md5(array_slice(b, i, i + 399)) AS p FROM (SELECT r, b, unnest(range(1, n - 398)) AS i FROM n WHERE n >= 400)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY p) AS c FROM win) WHERE c > 1),
far AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM dup),
isle AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM far),
span AS (SELECT r, min(i) AS a, max(i) + 399 AS z FROM isle GROUP BY r, g),
piece AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM span
          UNION ALL SELECT n.r, coalesce(max(z), 0) + 1, any_value(n.n) FROM n LEFT JOIN span USING (r) GROUP BY n.r),
kept AS (SELECT piece.r, coalesce(string_agg(hex(array_slice(b, f, t)), '' ORDER BY f), '') AS h FROM piece JOIN n USING (r) WHERE f <= t GROUP BY piece.r),
gone AS (SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM n LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""

QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
SQL = {"op9_suffix_dedup": ORACLE}
