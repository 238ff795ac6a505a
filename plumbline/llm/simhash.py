"""SimHash near-duplicates, found by multi-index hashing over Hamming balls of fingerprint segments.

A 64-bit fingerprint is cut into ``SEGMENTS`` segments, and each segment has a table of the distinct fingerprints by the
segment's value. If two fingerprints differ in at most ``DISTANCE`` bits, one of their segments differs in at most
DISTANCE div SEGMENTS bits. So every fingerprint enumerates, for each segment, the values in that segment's ball of
this radius, fetches the fingerprints that the table has under them, and verifies the complete distances.

Buckets of more than ``CROWD`` fingerprints (large groups of near copies) would be fetched by each of their members. A pair that only such
buckets hold lies in two of them, so the fingerprints of crowded buckets are linked among themselves another way,
which is exact too: each is entered under all whole fingerprints within one bit. Two fingerprints within two bits meet at a midpoint, an
entry holds at most 65 of them, and all are linked to its least one.

Fingerprints are first made distinct (copies share one), so links run between different texts only.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; texts of fewer
than three words are one shingle; repeated doc_ids keep their rows; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, graph

SHINGLE = 3
DISTANCE = 2
SEGMENTS = 2
#: Fingerprints in a bucket beyond which they are linked by whole entries.
CROWD = 64
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    prints = np.fromiter((h(joined[s : e - 1], SEED) for s, e in zip(starts, ends, strict=False)), np.uint64, len(ends))
    bits = np.zeros(64, np.int64)
    for i in range(0, len(prints), 1 << 16):  # bounded memory for very long texts
        bits += np.unpackbits(prints[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(prints), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) with fp the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            prints = np.fromiter((fingerprint(t) for t in common.as_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def _segment(s: int, segments: int) -> Column:
    width = 64 // segments
    return F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1))


def segment_tables(prints: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(bucket, fp): every fingerprint under each of its segments; a bucket is a segment's value and number."""
    return prints.select("fp", F.explode(F.array(*[_segment(s, segments) * segments + s for s in range(segments)])).alias("bucket"))


def segment_balls(prints: DataFrame, radius: int, segments: int = SEGMENTS) -> DataFrame:
    """(bucket, fp): every fingerprint under the members of each of its segments' balls."""
    bits = [0, *(1 << i for i in range(64 // segments))] if radius else [0]
    masks = F.array(*[F.lit(m).cast("long") for m in bits])

    def ball(s: int) -> Column:
        return F.transform(masks, lambda m: _segment(s, segments).bitwiseXOR(m) * segments + s)

    return prints.select("fp", F.explode(F.flatten(F.array(*map(ball, range(segments))))).alias("bucket"))


def _whole_entries(prints: DataFrame) -> DataFrame:
    """(entry, fp): every fingerprint under the fingerprints within one bit of it."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(m - (m >> 63 << 64)).cast("long") for m in (1 << i for i in range(64))])
    return prints.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("entry"), "fp")


def crowded_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within two bits of each other, as those of an entry are linked to its least."""
    shared = _whole_entries(prints).groupBy("entry").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a != z")
    # an entry's members are the known fingerprints within one bit of it, at most 65
    fetched = _whole_entries(shared.select(F.col("entry").alias("fp"))).toDF("b", "entry")
    return fetched.join(shared.select("entry", "a").hint("merge"), "entry").join(prints.select(F.col("fp").alias("b")).hint("merge"), "b").select("a", "b")


def near_links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Verified links (a, b, a < b) that connect every two distinct fingerprints within the distance (2 at most)."""
    radius = distance // segments
    if not 0 <= distance <= 2 or radius > 1 or 64 % segments or segments < 2:
        raise ValueError("distances of 0 to 2 over 2 segments or more that divide 64 are covered")
    tables = common.materialize(segment_tables(prints, segments), "simhash-tables")
    crowds = common.materialize(tables.groupBy("bucket").count().where(F.col("count") > crowd).select("bucket"), "simhash-crowds")
    calm = tables.join(crowds, "bucket", "left_anti").withColumnRenamed("fp", "other")
    # sorted, never broadcast: estimates do not see how many members a ball has
    fetched = segment_balls(prints, radius, segments).join(calm.hint("merge"), "bucket").where("fp != other")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    links = fetched.where(near("fp", "other")).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    crowded = tables.join(crowds, "bucket", "left_semi").select("fp").distinct()
    return links.unionByName(crowded_links(crowded).where((F.col("a") != F.col("b")) & near("a", "b"))).distinct()


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): component is the least key that links reach."""
    prints = common.materialize(fingerprints(docs, key=key, text=text), "fingerprints")
    distinct = common.materialize(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    roots = graph.components(near_links(distinct.select("fp")), "simhash")
    linked = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    of_print = linked.join(least, "root").select("fp", "component")
    return prints.join(of_print, "fp").select(key, "fp", F.coalesce("component", key).alias("component"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the least doc_id (null last; of equal ones the least digest of
    its text). Rows that repeat doc_id and text count as one document."""
    rows = common.with_digest(docs)
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("k"), F.col(common.DIGEST).alias("d"))
    extra = near_groups(rows.select(key.alias("key"), "text"), key="key").where("key != component").select(F.col("key.k").alias("_plumb_k"), F.col("key.d").alias("_plumb_d")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_plumb_k")) & (F.col(common.DIGEST) == F.col("_plumb_d"))
    return rows.join(extra.hint("merge"), same, "left_anti").select(*map(common.quoted, docs.columns))


QUERIES = {"op4_simhash": op4_simhash}
SQL: dict[str, str] = {}  # DuckDB has no seeded XXH64; tests compare with brute force
