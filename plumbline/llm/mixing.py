"""Mixing sources to target weights over packed token blocks.

Each source's documents form one word stream, packed into blocks of ``BLOCK`` words. The mix is a
list of slots, dealt over output shards: a source's slot total is its target, and how many of them
fall in each shard is a multinomial draw. Slot q of a source holds block ``perm_e(q mod B)`` of its B
blocks, where ``e = q div B`` numbers the pass over the source and ``perm_e`` is a keyed pseudorandom
permutation of the block indexes (a Feistel network, evaluated index by index). Slots and blocks
meet in an equi-join on (source, block). The last slot is cut so that the source's words sum to its
target, rounded down.

Draws depend on the seed, the source's rank and the shard only, so reruns agree. Shard counts come
from binomial splits of shard ranges, so no task needs the whole draw.

Scale: a source's stream is ordered by (hash bucket, key), so a source with a third of all rows is
summed in ``BUCKETS`` windows; only bucket totals, at most BUCKETS rows a source, meet per source.

Edge cases: null or blank text has size 0 and takes nothing; a null source is a source of its own,
last in order; repeated rows are separate documents; an empty table gives no rows; with no words at
all the targets are 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common

BLOCK = 256
SHARD_SLOTS = 4096
BUCKETS = 1024
SEED = 8191
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0


def _round(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    return common.mix(x + key)


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1, per element with its own n and key: a Feistel network on
    the least even number of bits that holds n, walked until the value is below n again."""
    half = np.ceil(np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 0.5)) / 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.ones(len(index), bool)
    while todo.any():
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            turn = np.uint64((3 - r if inverse else r) * 0x1D8E4E27C47D124F & (1 << 64) - 1)
            if inverse:
                left, right = right ^ (_round(left, k ^ turn) & m), left
            else:
                left, right = right, left ^ (_round(right, k ^ turn) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= n[todo].astype(np.uint64)
    return out.astype(np.int64)


def shard_range(n: int, shards: int, shard: int, seed: int, source: int) -> tuple[int, int]:
    """First slot and slot count of one shard, in a multinomial draw of n slots over equal shards."""
    first, low, high = 0, 0, shards
    while high - low > 1 and n:
        middle = (low + high) // 2
        draw = np.random.Generator(np.random.Philox(key=[seed << 32 | source, low << 32 | high]))
        left = int(draw.binomial(n, (middle - low) / (high - low)))
        if shard < middle:
            n, high = left, middle
        else:
            first, n, low = first + left, n - left, middle
    return first, n


def word_sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    def run(batches):
        for b in batches:
            size = np.fromiter((len((t or b"").split()) for t in common.as_bytes(b.column(2))), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size)], ["k", "source", "size"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, source string, size long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source: rank, words, target.

    Targets fill like water: with ``level`` the words a unit of weight gets, target = least(most *
    words, level * weight). A source is full if its ratio most * words / weight is below the level,
    so walking the sources by ratio finds the level without iterating. One row a source is sorted.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    up = Window.orderBy("ratio", "rank")
    walked = (
        ranked.withColumn("weight", weight)
        .withColumn("ratio", most * F.col("words") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum(most * F.col("words")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("reached", (share * F.sum("words").over(everything) - F.col("full")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("reached") <= F.col("ratio"), F.struct("ratio", "rank", "reached"))).over(everything)["reached"])
    )
    return walked.select("source", "rank", "words", F.least(most * F.col("words"), F.col("level") * F.col("weight")).alias("target"))


def slots(sources: DataFrame, *, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(rank, block, shard, slot, take): every slot of the mix, with the words it takes of its block."""
    total = F.sum(F.ceil(F.col("target") / block)).over(Window.partitionBy())
    shards = F.greatest(F.lit(1), F.ceil(total / shard_slots)).cast("int")
    rows = sources.where("target >= 1").select("rank", "words", F.floor(F.col("target") + 1e-6).cast("long").alias("take"), shards.alias("shards"))
    spread = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    spread = spread.repartition(common.narrow_partitions(sources.sparkSession, sources), "rank", "shard")

    def run(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                blocks = -(-r.words // block)
                passes, rest = divmod(r.take, r.words)
                n = min(2 * blocks, passes * blocks + (-(-rest // block) + 1 if rest else 0))
                first, count = shard_range(n, r.shards, r.shard, seed, r.rank)
                for at in range(first, first + count, 1 << 16):
                    q = np.arange(at, min(first + count, at + (1 << 16)))
                    turn, index = q // blocks, q % blocks
                    keys = common.mix(np.uint64(seed) + common.mix(np.uint64(r.rank) * np.uint64(1 << 20) + turn.astype(np.uint64)))
                    size = np.full(len(q), blocks, np.int64)
                    at_block = permute(index, size, keys)
                    short = block * blocks - r.words
                    short_at = permute(np.full(len(q), blocks - 1, np.int64), size, keys, inverse=True)
                    before = turn * r.words + index * block - short * (short_at < index)
                    take = np.clip(r.take - before, 0, block - short * (at_block == blocks - 1))
                    yield pd.DataFrame({"rank": r.rank, "block": at_block, "shard": r.shard, "slot": q, "take": take})[take > 0]

    return spread.mapInPandas(run, "rank int, block long, shard int, slot long, take long")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Per document: key, size, source_size, target, taken and placements (shard, slot, start, words)."""
    sized = common.materialize(word_sizes(docs, key, text, source).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sources = common.materialize(source_targets(sized), "mix-sources")
    # where each document begins in its source's stream
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int"))
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = totals.select("source", "bucket", before.alias("begin")).alias("b").join(sources.alias("s"), F.expr("b.source <=> s.source")).select(F.col("b.source").alias("of"), F.col("bucket").alias("in_bucket"), "begin", "rank", "words", "target")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("k", "size", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("inside", inside).join(begins, F.expr("bucket = in_bucket AND source <=> of")).withColumn("begin", F.col("begin") + F.col("inside"))
    # a piece is the part of one document that lies in one block
    last = F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = placed.select("row", "k", "size", "words", "target", "rank", "begin", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("begin") / block), last)).otherwise(F.array(F.lit(-1).cast("long")))).alias("block"))
    pieces = pieces.withColumn("a", F.greatest(F.lit(0), F.col("begin") - F.col("block") * block)).withColumn("b", F.least(F.lit(block), F.col("begin") + F.col("size") - F.col("block") * block))
    joined = pieces.join(slots(sources, block=block, seed=seed).hint("merge"), ["rank", "block"], "left").withColumn("got", F.greatest(F.lit(0), F.least(F.coalesce("take", F.lit(0)), "b") - F.col("a")))
    start = F.greatest(F.lit(0), F.col("block") * block - F.col("begin"))
    return (
        joined.groupBy("row", "k", "size", "words", "target")
        .agg(F.coalesce(F.sum("got"), F.lit(0)).alias("taken"), F.array_sort(F.collect_list(F.when(F.col("got") > 0, F.struct("shard", "slot", start.alias("start"), F.col("got").alias("words"))))).alias("placements"))
        .select(F.col("k").alias(key), "size", F.col("words").alias("source_size"), "target", "taken", "placements")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).drop("placements")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which words are taken, with size, source_size, target, words taken and the slots they go to.

    Where ``docs`` has a column of such a name, the mix's gets the prefix ``mix_``, as often as it takes.
    """
    rows = common.numbered(docs)
    key = F.struct(F.col("doc_id").alias("k"), F.col(common.ROW).alias("r"))
    mixed = mix(rows.select(key.alias("key"), "text", "source"), key="key").where("taken > 0")
    taken, more = {c.lower() for c in docs.columns}, {}
    for c in mixed.columns:
        if c != "key":
            name = c
            while name in taken:
                name = f"mix_{name}"
            taken.add(name)
            more[f"_plumb_{c}"] = name
    mixed = mixed.select(F.col("key.r").alias(common.ROW), *[F.col(c.removeprefix("_plumb_")).alias(c) for c in more])
    return rows.join(mixed, common.ROW).select(*map(common.quoted, docs.columns), *[F.col(c).alias(name) for c, name in more.items()])


QUERIES = {"op8_mixing": op8_mixing}
SQL: dict[str, str] = {}  # what a pseudorandom draw takes has no SQL form; tests compare with brute force
