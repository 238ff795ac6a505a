"""Helpers shared by the training-data operators: shared storage, Arrow batches, word spans and fingerprints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a Python worker turns into arrays at a time. A longer single text is still taken whole.
CHUNK_BYTES = 1 << 19

#: Multiplier of the rolling fingerprints (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: the session's ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, but only with a local master, as in tests.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where:
        return where
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more, as all that came from them is written."""
    for f in frames:
        sc = f.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f._plumbline_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: The row number that ``numbered`` adds, and the text digest that ``with_digest`` adds.
ROW = "_plumb_row"
DIGEST = "_plumb_digest"


def text_digest(text: Column) -> Column:
    """128 bits of the text's SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def with_digest(docs: DataFrame) -> DataFrame:
    """``docs`` with a digest of each text, which tells rows apart that lack or share a doc_id."""
    return docs.withColumn(DIGEST, text_digest(F.col("text")))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with a number for each row, so that rows which lack or share a doc_id can be told apart."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def quoted(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def narrow_partitions(spark: SparkSession, df: DataFrame, least: int = 1) -> int:
    """A partition count for a keyed shuffle: the session's, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) pieces of about ``most`` bytes, a few rows of the batch copied at a time; null counts as empty."""
    first, size, part = 0, 0, []
    for at in range(0, len(column), 256):
        for i, t in enumerate(as_bytes(column.slice(at, 256)), at):
            t = t or b""
            if part and size + len(t) > most:
                yield first, part
                first, size, part = i, 0, []
            part.append(t)
            size += len(t) + 1
    if part:
        yield first, part


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(16, int(n - 1).bit_length()) if n > 1 else 1 << 16
    return _powers(size, base)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``[^\\x20\\x09-\\x0D]`` in a byte buffer."""
    gap = np.empty(len(buf) + 2, bool)
    gap[0] = gap[-1] = True
    np.take(_SPACE, buf, out=gap[1:-1])
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[0::2], turn[1::2]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running fingerprint sums, so that every span's fingerprint is a difference of two."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_prints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the spans, the same wherever equal values stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), BASE_INV)[starts])


def byte_prints(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


class Words:
    """The words of some texts: one array of word fingerprints, with each text's range in it."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts), np.uint8)
        self.starts, self.ends = word_spans(self.buf)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(sizes + 1)))  # where each text begins in buf
        self.prints = span_prints(prefix_sums(byte_prints(self.buf)), self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.text_at)  # where each text begins among the words
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n words of one text stand, and those windows' fingerprints."""
        k = len(self.prints) - n + 1
        if k <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:k] == self.doc[n - 1 :])
        return at, span_prints(prefix_sums(self.prints), at, at + n)


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of the given length that starts at one of ``at``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + length, n), -1)
    return np.cumsum(step[:n]) > 0


def native_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
