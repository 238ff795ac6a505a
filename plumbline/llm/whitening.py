"""Embedding whitening: the exact scatter of integer vectors in a residue number system, then eigenvectors in double.

Entries c become integers floor(64 c) + 1000000, whose offset dwarfs their spread; in doubles the products of the sums would cancel.
Every task multiplies its vectors modulo several primes below 2**21, centred, so that a GEMM over ``BLOCK`` rows stays below
2**53 and is exact. Spark adds the residues of all tasks, and Chinese remaindering gives sums, scatter and covariance as integers of any size;
each covariance entry is rounded once. The eigenvectors come from ``eigh``, once more on the rotated matrix to polish them.

What the driver holds is a d x d matrix a prime; it depends on the dimension, not on the rows. Primes are taken until their product
covers the largest sum the table can make, so no size of table overflows.

Edge cases: a row goes if its vector is null or has a null, NaN or infinite entry; others stay, repeated and without vec_id too. The fit list
holds each distinct vector once. Entries past 9e18 / 64 in magnitude count as that. Vectors of another length are a set of their own, with their own n,
components and identity_error; empty vectors have no component. A component without variance (a constant table, n of 1, more components
than rows) has a null ``whitened``, and a null ``explained`` where there is no variance at all. A deviation past a long is null, while
``deviation_exact`` has its digits. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

SCALE, OFFSET = 64, 1_000_000
#: Largest magnitude of 64 c that is told apart; the sum with the offset fits a long.
WIDEST = 9.0e18
COMPONENTS = 16
#: Rows of one GEMM: 2**12 products of residues of at most 2**20 stay below 2**53.
BLOCK = 1 << 12


def primes(least_product: int) -> list[int]:
    """The largest primes below 2**21 whose product exceeds the given one."""
    out, product, p = [], 1, (1 << 21) - 1
    while product <= least_product:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def integers(vector: Column) -> Column:
    wide = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(WIDEST)), F.lit(-WIDEST))
    return F.transform(vector, lambda c: F.floor(wide(c)).cast("long") + OFFSET)


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) for each length of vector in a batch, ``BLOCK`` rows at a time; empty vectors are left out."""
    offsets = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(), np.diff(offsets)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            yield int(size), part, flat[offsets[part][:, None] + np.arange(size)]


def _added(cells: DataFrame, kind: str) -> DataFrame:
    """Sums over all tasks of rows (size, layer, i, values)."""
    each = cells.select("size", "layer", "i", F.posexplode("values").alias("j", "v"))
    return each.groupBy("size", "layer", "i", "j").agg(F.sum("v").cast(kind).alias("v"))


def residue_sums(vectors: DataFrame, moduli: dict[int, list[int]]) -> DataFrame:
    """size, layer, i, j, v: the products of entries i and j, summed over all vectors x of one length modulo its layer-th prime, up to a
    multiple of the prime. An entry 1 before the others gives the count and the sums."""

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for size, _, x in _by_size(b.column(0)):
                for layer, p in enumerate(moduli[size]):
                    r = np.ones((len(x), size + 1))
                    rest = np.mod(x, p)
                    r[:, 1:] = rest - p * (rest > p // 2)
                    new = (r.T @ r).astype(np.int64)
                    held[size, layer] = np.mod(held.get((size, layer), 0) + new, p)
        for (size, layer), m in held.items():
            n = len(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, layer, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(m), pa.list_(pa.int64()))], ["size", "layer", "i", "values"])

    return _added(vectors.mapInArrow(run, "size int, layer int, i int, values array<long>"), "long")


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers, of either sign, that leave these residues (Chinese remainder theorem)."""
    product = 1
    for p in moduli:
        product *= p
    total = np.zeros(residues[0].shape, object)
    for r, p in zip(residues, moduli, strict=True):
        rest = product // p
        total = total + np.mod(r, p).astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


@dataclass
class Whitening:
    """n vectors of one length: their sums, unit eigenvectors as columns, eigenvalues, shares of the trace, and what the rows showed."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    real: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        top = int(max(abs(int(x.max())), abs(int(x.min()))))
        kind = np.int64 if self.n * top + max(map(abs, self.sums)) < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def project(self, centred: np.ndarray) -> np.ndarray:
        z = (centred / self.n).astype(np.float64) @ self.vectors
        return z / np.sqrt(np.where(self.real, self.values, 1))


def decompose(n: int, sums: np.ndarray, scatter: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """From exact sums and products: covariance entries rounded once, eigenvectors by falling eigenvalue, largest entry positive."""
    spread = scatter * n - np.multiply.outer(sums, sums)
    square = n * n
    v = np.array([[c / square for c in row] for row in spread], np.float64)
    _, q = np.linalg.eigh(v)
    _, turn = np.linalg.eigh((q.T.astype(np.longdouble) @ v.astype(np.longdouble) @ q.astype(np.longdouble)).astype(np.float64))
    q = q @ turn
    q /= np.linalg.norm(q, axis=0)
    wide = q.astype(np.longdouble)
    e = np.einsum("ij,ik,kj->j", wide, v.astype(np.longdouble), wide, optimize=True).astype(np.float64)
    order = np.argsort(-e, kind="stable")[:components]
    q, e = q[:, order], e[order]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1, 1)
    trace = sum(spread[i, i] for i in range(len(spread))) / square
    real = e > len(v) * np.finfo(float).eps * max(e.max(), 0.0)
    return Whitening(n, [int(s) for s in sums], q, e, [max(float(x), 0.0) / trace if trace > 0 else None for x in e], real & (trace > 0))


def _identity_errors(vectors: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance minus the identity, measured on the rows."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for size, _, x in _by_size(b.column(0)):
                m = models[size]
                z = np.column_stack([np.ones(len(x)), m.project(m.centred(x))])
                held[size] = held.get(size, 0) + z.T @ z
        for size, s in held.items():
            n = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(s), pa.list_(pa.float64()))], ["size", "layer", "i", "values"])

    found = _added(vectors.mapInArrow(run, "size int, layer int, i int, values array<double>"), "double").toArrow()
    out = {}
    for size, m in models.items():
        k = m.vectors.shape[1] + 1
        s = _matrix(found, size, 0, k)
        cov = s[1:, 1:] / m.n - np.multiply.outer(s[0, 1:], s[0, 1:]) / m.n**2
        if m.real.any():
            out[size] = float(np.abs(cov - np.eye(k - 1))[np.ix_(m.real, m.real)].max())
    return out


def _matrix(found: pa.Table, size: int, layer: int, n: int) -> np.ndarray:
    columns = [found.column(c).to_numpy() for c in ("size", "layer", "i", "j", "v")]
    own = (columns[0] == size) & (columns[1] == layer)
    out = np.zeros((n, n), columns[4].dtype)
    out[columns[2][own], columns[3][own]] = columns[4][own]
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of vector, from the distinct vectors (one column x, array<long>)."""
    listed = common.materialize(vectors.select("x").distinct(), "fit-list")
    sizes = listed.where(F.size("x") > 0).groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("top")).collect()
    moduli = {r["size"]: primes(2 * r["n"] * max(r["top"], 1) ** 2 + 1) for r in sizes}
    found = residue_sums(listed, moduli).toArrow()
    models = {}
    for r in sizes:
        size = r["size"]
        whole = remaindered([_matrix(found, size, k, size + 1) for k in range(len(moduli[size]))], moduli[size])
        models[size] = decompose(int(whole[0, 0]), whole[0, 1:], whole[1:, 1:], components)
    for size, error in _identity_errors(listed, models).items():
        models[size].identity_error = error
    common.release(listed)
    return models


def apply(rows: DataFrame, models: dict[int, Whitening], key: str = "vec_id") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error and deviation_exact for every row (key, x) and component."""

    def run(batches):
        for b in batches:
            for size, at, x in _by_size(b.column(1)):
                m = models[size]
                centred = m.centred(x)
                z = m.project(centred)
                top = int(max(abs(int(centred.max())), abs(int(centred.min()))))
                exact = centred if top * top * size < 1 << 63 else centred.astype(object)
                total = (exact * exact).sum(axis=1)
                own = [None if not ok else z[:, c] for c, ok in enumerate(m.real)]
                k = len(own)
                scores = [pa.nulls(len(x), pa.float64()) if o is None else pa.array(o) for o in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([b.column(0).take(pa.array(at))] * k),
                        pa.array(np.repeat(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, m.n, np.int64)),
                        pa.array([int(t) if t < 1 << 63 else None for t in total] * k, pa.int64()),
                        pa.concat_arrays(scores),
                        pa.array([v for v in m.explained for _ in range(len(x))], pa.float64()),
                        pa.array([m.identity_error] * (len(x) * k), pa.float64()),
                        pa.array([str(int(t)) for t in total] * k, pa.string()),
                    ],
                    ["k", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(F.col(key).alias("k"), "x").mapInArrow(run, f"k {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
    return found.withColumnRenamed("k", key)


def whiten(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``apply`` of what ``fit`` finds in the rows' own vectors."""
    rows = embeddings.where(usable(common.quoted(vector))).select(common.quoted(key).alias(key), integers(common.quoted(vector)).alias("x"))
    return apply(rows, fit(rows, components), key)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op11_whitening": op11_whitening}
SQL: dict[str, str] = {}  # SQL has no eigenvectors; tests compare with integers of Python
