"""Repeated windows of symbol sequences (words or bytes), found through content-defined anchors.

A window of W symbols contains W - G + 1 grams of G symbols; the least gram print among them is the
window's anchor. Equal windows have equal anchors, so a window whose anchor gram stands nowhere else
cannot repeat. Consecutive windows with equal anchor grams form a run (so periodic text is one run); equal runs (equal bodies) are copies as a whole, and only
distinct bodies around the same gram need comparing window by window.

Prints (64 bits, polynomial) only sort candidates out: equal symbols have equal prints, and what shares a print by
chance is compared further. Equality is decided by 128-bit BLAKE2 digests of the symbols, or by the symbols themselves.

A document is named by its key and a digest of its text, so rows that lack or share a key are judged each by its own text.

The plan of ``Search``, each step linear in the corpus and without a bound on any group:

1. grams of all runs are counted (map-side combining), those seen once drop out;
2. a bitmap of the repeated grams, of at most ``BITMAP_BITS`` bits, goes to the tasks, which pass on the
   runs that may repeat. The bitmap only spares shuffling: a false hit is found out by the exact
   steps that follow, and a full bitmap merely spares less;
3. runs with equal bodies are collapsed to their first occurrence and a count;
4. bodies that share a gram with another body get their symbols, and go, by gram, to shards of about ``SHARD`` symbols;
   a shard tells, for every window of its bodies, whether it starts earlier elsewhere.
   Where the bodies around one gram hold more than ``SHARD`` symbols they are split first: their windows become bodies of
   their own, keyed by their own digest, so that no shard must hold all text around a very frequent gram;
5. verdicts return to the documents by their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

BITMAP_BITS = 1 << 28
SHARD = 1 << 19


def digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, d, t): key, digest of the text and text of every row."""
    return docs.select(F.col(key).alias("k"), common.text_digest(F.col(text)).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))


@dataclass
class Block:
    """The symbols of some texts: a print each, and each text's range."""

    prints: np.ndarray
    first: np.ndarray  # where each text begins, and the end
    raw: bytes
    starts: np.ndarray | None = None  # of words in raw; bytes stand where they stand
    ends: np.ndarray | None = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def piece(self, at: int, n: int) -> bytes:
        """n symbols from ``at`` on; words with one space between."""
        if self.starts is None:
            return self.raw[at : at + n]
        return b" ".join(self.raw[self.starts[at] : self.ends[at + n - 1]].split())


def byte_block(texts: list[bytes]) -> Block:
    raw = b"".join(texts)
    first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    return Block(common.byte_prints(np.frombuffer(raw, np.uint8)), first, raw)


def word_block(texts: list[bytes]) -> Block:
    words = common.Words(texts)
    return Block(words.prints, words.first, words.buf.tobytes(), words.starts, words.ends)


@dataclass
class Runs:
    """Runs of windows with equal anchor grams: print of the gram, text, first window (in its text), windows, the first
    window's anchor (in the block) and the number of places the gram anchors from."""

    gram: np.ndarray
    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    places: np.ndarray

    def __getitem__(self, keep: np.ndarray) -> Runs:
        return Runs(self.gram[keep], self.text[keep], self.start[keep], self.windows[keep], self.anchor[keep], self.places[keep])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones: running minima from both ends of blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def find_runs(block: Block, window: int, gram: int, by_place: bool = False) -> Runs:
    """The runs of a block; ``by_place`` cuts them where the anchor moves on to another place of the same gram."""
    n = len(block.prints) - window + 1
    empty = np.empty(0, np.int64)
    none = Runs(empty.astype(np.uint64), empty, empty, empty, empty, empty)
    if n <= 0:
        return none
    sums = common.prefix_sums(block.prints)
    at = np.arange(len(block.prints) - gram + 1)
    grams = common.span_prints(sums, at, at + gram)
    # the print's upper bits with the position below: equal uppers go to the leftmost, in every copy alike
    low = np.uint64(max(26, len(at).bit_length()))
    anchor = (sliding_least((grams >> low << low) | at.astype(np.uint64), window - gram + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    doc = block.doc
    whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(whole):
        return none
    a = anchor[whole]
    own = grams[a]
    moved = np.concatenate(([True], a[1:] != a[:-1]))
    apart = np.concatenate(([True], (own[1:] != own[:-1]) | (whole[1:] != whole[:-1] + 1)))
    new = np.flatnonzero(apart | moved if by_place else apart)
    start, count = whole[new], np.diff(np.concatenate((new, [len(whole)])))
    text = doc[start]
    moved[new] = True
    places = np.add.reduceat(moved.astype(np.int64), new)
    return Runs(own[new], text, start - block.first[text], count, a[new], places)


def _hits(prints: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = prints % np.uint64(len(bitmap) * 8)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap_of(prints: DataFrame) -> np.ndarray:
    """One bit a print (column p, long), 32 bits for each of them while that is within ``BITMAP_BITS``; built in slices."""
    n = prints.count()
    bits = min(BITMAP_BITS, 1 << max(12, (32 * n).bit_length()))
    slices = min(bits // 4096, 1 << max(4, (n // 500_000).bit_length()))
    size = bits // slices // 8

    def fill(key, table):
        part = np.zeros(size * 8, bool)
        part[(table.column("p").to_numpy() & (bits - 1)) - key[0].as_py() * size * 8] = True
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    # p mod bits as for an unsigned value; bits is a power of two
    sliced = prints.select("p", F.floor(F.expr(f"p & {bits - 1}L") / (size * 8)).alias("slice"))
    out = np.zeros(bits // 8, np.uint8)
    for r in sliced.groupBy("slice").applyInArrow(fill, "slice long, part binary").toLocalIterator():
        out[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.part, np.uint8)
    return out


def blocks(docs: DataFrame, make: Callable[[list[bytes]], Block], schema: str, emit: Callable[[Block, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``emit`` for blocks of ``docs`` (k, d, t), with the rows of k and d that belong to each."""

    def run(batches):
        for b in batches:
            names = b.select([0, 1])
            for first, texts in common.text_chunks(b.column(2)):
                yield from emit(make(texts), names.slice(first, len(texts)))

    return docs.select("k", "d", "t").mapInArrow(run, schema)


def repeated_grams(docs: DataFrame, make: Callable[[list[bytes]], Block], window: int, gram: int, name: str):
    """A broadcast bitmap of the anchor grams that anchor from two places or more."""

    def count(block, names):
        runs = find_runs(block, window, gram)
        grams, at = np.unique(runs.gram, return_inverse=True)
        n = np.bincount(at, runs.places, len(grams)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["p", "n"])

    counted = blocks(docs, make, "p long, n long", count).groupBy("p").agg(F.sum("n").alias("n"))
    repeated = common.materialize(counted.where("n > 1").select("p"), f"{name}-grams")
    return docs.sparkSession.sparkContext.broadcast(bitmap_of(repeated))


def _places(names: pa.RecordBatch, runs: Runs) -> np.ndarray:
    """A print of each run's document and start."""
    heads = np.array([int.from_bytes(x[:8], "little") for x in names.column(1).to_pylist()], np.uint64)
    return common.mix(heads[runs.text] + common.mix(runs.start.astype(np.uint64)))


#: Columns that name a place: key and text digest of the document, and where a run starts.
PLACE = ("k", "d", "start")


@dataclass
class Search:
    """Repeated windows of ``docs`` (as ``named`` gives them)."""

    docs: DataFrame
    make: Callable[[list[bytes]], Block]
    window: int
    gram: int
    name: str
    temporaries: list[DataFrame] = field(default_factory=list)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written for as long as the search lasts."""
        self.temporaries.append(common.materialize(df, f"{self.name}-{name}"))
        return self.temporaries[-1]

    @property
    def _key(self) -> str:
        return self.docs.schema["k"].dataType.simpleString()

    def candidates(self) -> DataFrame:
        """(gram, b0, b1, k, d, start, windows, places, at): the runs whose gram may stand elsewhere too; b0 and b1 are
        the body's digest, ``at`` a print of the place."""
        window, gram = self.window, self.gram
        bitmap = repeated_grams(self.docs, self.make, window, gram, self.name)

        def passing(block, names):
            runs = find_runs(block, window, gram)
            runs = runs[_hits(runs.gram, bitmap.value)]
            begins = (block.first[runs.text] + runs.start).tolist()
            bodies = np.frombuffer(b"".join(digest(block.piece(a, n + window - 1)) for a, n in zip(begins, runs.windows.tolist(), strict=True)), "<i8").reshape(-1, 2)
            rows = pa.array(runs.text)
            columns = [pa.array(runs.gram.view(np.int64)), pa.array(bodies[:, 0]), pa.array(bodies[:, 1]), names.column(0).take(rows), names.column(1).take(rows), *(pa.array(x, pa.int64()) for x in (runs.start, runs.windows, runs.places)), pa.array(_places(names, runs).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "b0", "b1", "k", "d", "start", "windows", "places", "at"])

        schema = f"gram long, b0 long, b1 long, k {self._key}, d binary, start long, windows long, places long, at long"
        return self._written(blocks(self.docs, self.make, schema, passing), "runs")

    def bodies(self, candidates: DataFrame) -> DataFrame:
        """(gram, b0, b1, first (k, d, start, at), windows, places, copies): distinct bodies with their first occurrence."""
        first = F.min(F.struct(*PLACE, "at")).alias("first")
        return self._written(candidates.groupBy("gram", "b0", "b1").agg(first, F.max("windows").alias("windows"), F.max("places").alias("places"), F.count("*").alias("copies")), "bodies")

    def shared(self, bodies: DataFrame) -> DataFrame:
        """``bodies`` whose gram has others too or stands twice inside, with the symbols of all of them as ``load``.

        The loads are written first, so that the join's two sides are plain shuffles and a hot gram's can be split.
        """
        grams = bodies.groupBy("gram").agg(F.count("*").alias("_n"), F.max("places").alias("_p"), F.sum(F.col("windows") + self.window - 1).alias("load"))
        loads = self._written(grams.where("_n > 1 OR _p > 1").select("gram", "load"), "loads")
        return self._written(bodies.join(loads, "gram"), "shared")

    def fragments(self, shared: DataFrame) -> DataFrame:
        """``shared`` with each body's symbols, taken from its first occurrence."""
        bitmap = self.docs.sparkSession.sparkContext.broadcast(bitmap_of(shared.select(F.col("first.at").alias("p")).distinct()))
        window, gram = self.window, self.gram

        def cut(block, names):
            runs = find_runs(block, window, gram)
            runs = runs[_hits(_places(names, runs), bitmap.value)]
            begins = (block.first[runs.text] + runs.start).tolist()
            symbols = [block.piece(a, n + window - 1) for a, n in zip(begins, runs.windows.tolist(), strict=True)]
            rows = pa.array(runs.text)
            yield pa.RecordBatch.from_arrays([pa.array(runs.gram.view(np.int64)), names.column(0).take(rows), names.column(1).take(rows), pa.array(runs.start, pa.int64()), pa.array(symbols, pa.binary())], ["gram", *PLACE, "symbols"])

        cuts = blocks(self.docs, self.make, f"gram long, k {self._key}, d binary, start long, symbols binary", cut)
        s, c = shared.alias("s"), cuts.alias("c")
        same = F.expr("s.gram = c.gram AND s.first.d = c.d AND s.first.k <=> c.k AND s.first.start = c.start")
        return s.join(c, same).select("s.*", "c.symbols").dropDuplicates(["gram", "b0", "b1"])

    def split(self, fragments: DataFrame) -> DataFrame:
        """(gram, b0, b1, w0, w1, part, place): the single windows of bodies, w0 and w1 the window's digest, ``part`` its
        place in the body and ``place`` in the corpus."""
        window, make = self.window, self.make

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    block, n = make([row["symbols"]]), row["windows"]
                    own = np.frombuffer(b"".join(digest(block.piece(i, window)) for i in range(n)), "<i8").reshape(-1, 2)
                    same = [pa.array(np.full(n, row[c])) for c in ("gram", "b0", "b1")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(np.arange(n), pa.int64())], ["gram", "b0", "b1", "w0", "w1", "part"])

        cut = fragments.select("gram", "b0", "b1", "windows", "symbols").mapInArrow(run, "gram long, b0 long, b1 long, w0 long, w1 long, part long")
        return cut.join(fragments.select("gram", "b0", "b1", "first"), ["gram", "b0", "b1"]).select("gram", "b0", "b1", "w0", "w1", "part", F.struct("first.k", "first.d", (F.col("first.start") + F.col("part")).alias("start")).alias("place"))

    def verdicts(self, judge: Callable[[list[dict]], list[np.ndarray]]) -> tuple[DataFrame, DataFrame]:
        """(candidates, verdicts): verdicts has gram, b0, b1, first, copies and mask, for bodies with copies
        or hit windows; the mask's bit i tells that window i of the body's first occurrence also starts earlier.

        ``judge`` takes a shard's bodies (dicts of a fragment's columns) and gives a boolean array for each.
        """
        found = self.candidates()
        bodies = self.bodies(found)
        fragments = self._written(self.fragments(self.shared(bodies)), "fragments")
        cool, hot = fragments.where(F.col("load") <= SHARD), fragments.where(F.col("load") > SHARD)
        size = fragments.agg(F.coalesce(F.sum(F.col("windows") + self.window - 1), F.lit(0))).first()[0]
        shards = max(common.narrow_partitions(self.docs.sparkSession, self.docs), -(-size // SHARD))
        schema = "gram long, b0 long, b1 long, mask binary"

        def judged(batches):
            rows = [r for b in batches for r in b.to_pylist()]
            if rows:
                masks = judge(rows)
                hit = [i for i, m in enumerate(masks) if m.any()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([rows[i][c] for i in hit], pa.int64()) for c in ("gram", "b0", "b1")), pa.array([np.packbits(masks[i], bitorder="little").tobytes() for i in hit], pa.binary())],
                    ["gram", "b0", "b1", "mask"],
                )

        masks = cool.repartition(shards, "gram").mapInArrow(judged, schema)
        windows = self._written(self.split(hot), "windows")
        firsts = self._written(windows.groupBy("w0", "w1").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
        hits = windows.join(firsts, ["w0", "w1"]).where("earliest < place")

        def packed(key, table):
            bits = np.zeros(max(table.column("part").to_pylist()) + 1, bool)
            bits[table.column("part").to_numpy()] = True
            return pa.table({n: pa.array([k.as_py()], pa.int64()) for n, k in zip(("gram", "b0", "b1"), key, strict=True)} | {"mask": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        masks = self._written(masks.unionByName(hits.select("gram", "b0", "b1", "part").groupBy("gram", "b0", "b1").applyInArrow(packed, schema)), "masks")
        return found, bodies.join(masks, ["gram", "b0", "b1"], "left").where("copies > 1 OR mask IS NOT NULL").select("gram", "b0", "b1", "first", "copies", "mask")


def marks(search: Search, found: DataFrame, verdicts: DataFrame, rule: Column) -> DataFrame:
    """(k, d, marks), written, which ends the search: each document's runs with hits as (start, windows, mask); ``rule`` is the mask that applies to a
    run, an expression over the run's and its verdict's columns; an empty one stands for all windows."""
    joined = found.join(search._written(verdicts, "verdicts"), ["gram", "b0", "b1"]).withColumn("hit", rule).where("hit IS NOT NULL")
    # written before its join, so that the join's two sides are plain shuffles and a text with many copies can be split
    out = common.materialize(joined.groupBy("k", "d").agg(F.collect_set(F.struct("start", "windows", F.col("hit").alias("mask"))).alias("marks")), f"{search.name}-marks")
    common.release(*search.temporaries)
    return out


def hit_windows(rows: list[dict] | None) -> np.ndarray:
    """Starts of a document's hit windows, in no order."""
    parts = [np.empty(0, np.int64)]
    for r in rows or ():
        if r["mask"]:
            bits = np.unpackbits(np.frombuffer(r["mask"], np.uint8), bitorder="little")[: r["windows"]]
            parts.append(r["start"] + np.flatnonzero(bits))
        else:
            parts.append(r["start"] + np.arange(r["windows"]))
    return np.concatenate(parts)


def apply(docs: DataFrame, marked: DataFrame, same: str, schema: str, work: Callable[[bytes, list[dict] | None], tuple], types: list[pa.DataType]) -> DataFrame:
    """``work(text, marks)``, of the types given, for every document of ``docs``; ``same`` joins them (as d) to ``marked`` (as m)."""
    names = [x.split(":")[0].split()[0] for x in schema.split(", ")]
    joined = docs.alias("d").join(marked.alias("m"), F.expr(same), "left").select("d.k", "d.t", "m.marks")

    def run(batches):
        for b in batches:
            keys, marks = b.column(0), b.column(2)
            for first, texts in common.text_chunks(b.column(1)):
                rows = [work(t, m) for t, m in zip(texts, marks.slice(first, len(texts)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(texts)), *map(pa.array, zip(*rows, strict=True), types)], names)

    return joined.mapInArrow(run, schema)
