"""Embedding whitening: exact scatter by bit planes, then principal components scaled to unit variance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrad.llm.common import read_table
from loomgrad.operators.merging import array_sums
from loomgrad.session import materialise

#: Steps of a unit that entries are rounded down to.
STEPS = 256
COMPONENTS = 4
#: Rows whose bit planes are packed together.
BLOCK_ROWS = 4096
#: Words that are and-ed at once: what bounds a task's memory.
WORDS_AT_ONCE = 1 << 20
#: Sums travel as limbs of 32 bits: exact up to 2**160, and whole longs when millions of tasks add up.
_LIMBS, _LIMB = 5, (1 << 32) - 1


def whole_steps(vectors: Column, steps: int = STEPS) -> Column:
    """array<long>: floor(steps * entry) of each entry; beyond the range of a long, its end."""
    return F.transform(vectors, lambda c: F.floor(c.cast("double") * F.lit(float(steps))))


def usable(vectors: Column) -> Column:
    """Whether a vector has entries, and all are finite numbers."""
    good = F.forall(vectors, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vectors.isNotNull() & (F.size(vectors) > 0) & good, F.lit(False))


# --- bit-sliced scatter -----------------------------------------------------------------------


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least of each dimension, planes): bit b of every row's distance to the least, 64 rows a word: (bits, dimensions, words)."""
    least = x.min(axis=0)
    above = x.view(np.uint64) - least.view(np.uint64)  # wraps rightly, however far apart
    bits = max(1, int(above.max()).bit_length())
    out = np.zeros((bits, x.shape[1], -(-len(x) // 64) * 8), dtype=np.uint8)
    for b in range(bits):
        packed = np.packbits(((above >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        out[b, :, : packed.shape[1]] = packed
    return least, out.view(np.uint64)


def plane_products(planes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, products) of the shifted values: each product of two dimensions is the popcount of every pair of their planes, weighted."""
    bits, d, words = planes.shape
    exact = np.int64 if 2 * bits + n.bit_length() < 63 else object
    weights = np.array([1 << b for b in range(bits)], dtype=exact)
    sums = np.tensordot(weights, np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(exact), 1)
    products, at_once = np.zeros((d, d), dtype=object), max(1, WORDS_AT_ONCE // (bits * bits * words))
    both = np.multiply.outer(weights, weights)
    for i in range(d):
        for j in range(i, d, at_once):
            common = planes[:, None, i, None, :] & planes[None, :, j : j + at_once, :]
            counts = np.bitwise_count(common).sum(axis=3, dtype=np.int64)
            products[i, j : j + at_once] = (both[:, :, None] * counts.astype(exact)).sum(axis=(0, 1))
    return sums.astype(object), products


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, products) of the rows of an (n, d) matrix of longs, as exact Python numbers; products above the diagonal only."""
    d = x.shape[1]
    total, products = np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
    for at in range(0, len(x), BLOCK_ROWS):
        part = np.ascontiguousarray(x[at : at + BLOCK_ROWS])
        least, planes = bit_planes(part)
        sums, crossed = plane_products(planes, len(part))
        low = least.astype(object)
        products += np.triu(crossed + np.multiply.outer(low, sums) + np.multiply.outer(sums, low) + len(part) * np.multiply.outer(low, low))
        total += sums + len(part) * low
    return total, products


def _to_limbs(numbers: np.ndarray) -> np.ndarray:
    parts = [(numbers >> 32 * k) & _LIMB for k in range(_LIMBS - 1)] + [numbers >> 32 * (_LIMBS - 1)]
    return np.concatenate([p.astype(np.int64) for p in parts])


def _from_limbs(limbs: np.ndarray) -> np.ndarray:
    return sum(part.astype(object) << 32 * k for k, part in enumerate(limbs.reshape(_LIMBS, -1)))


def vectors_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_moments(stored: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, products) of the vectors ``x`` of length ``d``, as Python numbers."""
    upper = np.triu_indices(d)

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n, total, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            if batch.num_rows:
                s, p = scatter(vectors_of(batch.column(0), d))
                n, total, products = n + batch.num_rows, total + s, products + p
        return _to_limbs(np.concatenate([np.array([n], dtype=object), total, products[upper]]))

    got = _from_limbs(array_sums(stored.select("x"), work, _LIMBS * (1 + d + len(upper[0])), np.int64))
    products = np.zeros((d, d), dtype=object)
    products[upper] = got[1 + d :]
    return int(got[0]), got[1 : 1 + d], products + np.triu(products, 1).T


# --- components -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """Projections of centred vectors on components of unit variance."""

    n: int
    sums: np.ndarray
    #: (d, k) unit eigenvectors over the root of their eigenvalues; those without variance are zero.
    directions: np.ndarray
    #: Which components have variance.
    spread: np.ndarray
    #: Shares of the trace; None without variance.
    explained: tuple[float | None, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if len(x) and max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums)) >= 1 << 62:
            return self.n * x.astype(object) - self.sums
        return self.n * x - self.sums.astype(np.int64)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.directions


def whitening_of(n: int, sums: np.ndarray, products: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """From exact moments: the covariance is centred as whole numbers, and only then divided and decomposed."""
    covariance = ((n * products - np.multiply.outer(sums, sums)) / (n * n)).astype(np.float64)
    values, vectors = np.linalg.eigh(covariance)
    k, trace = min(components, len(sums)), float(np.trace(covariance))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    spread = values > trace * len(sums) * np.finfo(float).eps
    directions = np.where(spread, vectors / np.sqrt(np.where(spread, values, 1.0)), 0.0)
    return Whitening(n, sums, directions, spread, tuple(float(v) / trace if trace > 0 else None for v in values))


def identity_error(stored: DataFrame, fitted: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, as measured on it."""
    d, k = fitted.directions.shape
    if not fitted.spread.any():
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((k + 1) * k)
        for batch in batches:
            if batch.num_rows:
                w = fitted.project(fitted.centred(vectors_of(batch.column(0), d)))
                sums += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        return sums

    got = array_sums(stored.select("x"), work, (k + 1) * k) / fitted.n
    covariance = got[k:].reshape(k, k) - np.multiply.outer(got[:k], got[:k])
    return float(np.abs(covariance - np.eye(k))[np.ix_(fitted.spread, fitted.spread)].max())


def _deviation(centred: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None if a long can't hold it."""
    if centred.dtype != object and (not len(centred) or int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 63):
        return (centred * centred).sum(axis=1).tolist()
    wide = centred.astype(object)
    return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()]


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, steps: int = STEPS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Entries become whole numbers of 1 / ``steps``. Moments of the distinct vectors are exact: a task packs
    the bit planes of its rows into words and adds up weighted popcounts of and-ed planes; limbs of 32 bits
    are added in executors, and the driver gets at most 64 arrays, whatever the number of rows.

    Rows whose vector is null, empty, or holds a null or non-finite entry take no part, as do those of
    another length than most distinct vectors have (the longer one if tied). Copies count once in the fit
    and are each returned, as are rows without an id. A component without variance has a null ``whitened``;
    a ``deviation`` that a long can't hold is null. Other columns are ignored. No rows in, no rows out.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    whole = base.select("vec_id", whole_steps(F.col("v"), steps).alias("x"))
    stored = materialise(whole.select("x").distinct())
    lengths = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], _SCHEMA)
    d = lengths["d"]
    stored = stored.filter(F.size("x") == d)
    fitted = whitening_of(*exact_moments(stored, d), components)
    error, k = identity_error(stored, fitted), fitted.directions.shape[1]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = fitted.centred(vectors_of(batch.column(1), d))
            whitened = fitted.project(centred)
            ids, deviation = batch.column(0), pa.array(_deviation(centred), pa.int64())
            for c in range(k):
                same = lambda value, kind, m=batch.num_rows: pa.array([value] * m, kind)
                w = pa.array(whitened[:, c]) if fitted.spread[c] else same(None, pa.float64())
                tail = [w, same(fitted.explained[c], pa.float64()), same(error, pa.float64())]
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays([ids, same(c + 1, pa.int32()), same(fitted.n, pa.int64()), deviation, *tail], names=names)

    return whole.filter(F.size("x") == d).mapInArrow(emit, _SCHEMA)


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
