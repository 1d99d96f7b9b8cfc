"""Whitening of vectors by an exact scatter matrix, counted on bit planes."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from habitloom.llm.common import pick

# Added to every scaled entry.
OFFSET = 1_000_000
# Rows whose bit planes are packed and multiplied at once.
ROWS = 4096
# Scaled entries beyond this are taken as at it, so that every sum below has a place.
LIMIT = 1 << 52
# Sums leave a task in two halves of so many bits.
HALF = 60
# An eigenvalue this small beside the greatest, times the dimensions, is rounding.
ROUNDING = 2.0 ** -52
SUMS = "dim int, i int, j int, n bigint, high bigint, low bigint"


def vectors(batch_vectors, scale: int):
    """``(rows, matrix)`` per dimension: the finite vectors of an Arrow list column as ``floor(scale * c)``, and their rows."""
    column = batch_vectors.cast(pa.list_(pa.float64()))
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null entries come as NaN
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        matrix = flat[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(matrix).all(axis=1)
        with np.errstate(over="ignore"):
            scaled = np.clip(np.floor(matrix[good] * scale), -LIMIT, LIMIT)
        yield rows[good], scaled.astype(np.int64)


def cross_products(matrix):
    """Sums of products of the columns of an integer matrix, exact, as a matrix of whole numbers.

    Each column is shifted to begin at 0 and sliced into bit planes, whose bits
    are packed across rows into 64-bit words. A product of two columns is the
    sum, over pairs of their planes, of the bits that both have set, each pair
    weighed by its two places. The shift is taken back exactly.
    """
    n, dim = matrix.shape
    low = matrix.min(axis=0)
    shifted = matrix - low
    width = [int(m).bit_length() for m in shifted.max(axis=0)]
    owner = np.repeat(np.arange(dim), width)
    place = np.concatenate([np.arange(w) for w in width]).astype(int) if owner.size else np.zeros(0, int)
    bits = np.zeros((len(owner), -(-n // 64) * 64), np.uint8)
    bits[:, :n] = (shifted[:, owner] >> place).T & 1
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    small = 2 * max(width, default=0) + n.bit_length() < 62
    kind = np.int64 if small else object
    weight = np.array([1 << int(p) for p in place], dtype=kind)
    product = np.zeros((dim, dim), kind)
    for a in range(len(owner)):
        common = np.bitwise_count(planes[a] & planes[a:]).sum(axis=1, dtype=np.int64).astype(kind) * weight[a:] * weight[a]
        if len(common) > 1:
            np.add.at(product[owner[a]], owner[a + 1:], common[1:])
            np.add.at(product[:, owner[a]], owner[a + 1:], common[1:])
        product[owner[a], owner[a]] += common[0]
    product, low = product.astype(object), low.astype(object)
    total = shifted.astype(kind).sum(axis=0).astype(object)
    return product + np.outer(low, total) + np.outer(total, low) + n * np.outer(low, low), total + n * low


def _sums(table: DataFrame, scale: int) -> DataFrame:
    """Per dimension, summed over all vectors: cross-products of entries ``i <= j``, and with ``i = -1`` the sums of entries ``j``."""
    fields = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])

    def halves(values):
        return [int(v) >> HALF for v in values], [int(v) & ((1 << HALF) - 1) for v in values]

    def scatter(batches):
        held = {}
        for batch in batches:
            for _, matrix in vectors(batch.column(0), scale):
                for at in range(0, len(matrix), ROWS):
                    part = matrix[at:at + ROWS]
                    product, total = cross_products(part)
                    n, products, totals = held.get(part.shape[1], (0, 0, 0))
                    held[part.shape[1]] = n + len(part), products + product, totals + total
        for dim, (n, products, totals) in held.items():
            i, j = np.triu_indices(dim)
            high, low = halves([*totals, *products[i, j]])
            i, j = np.concatenate([np.full(dim, -1), i]), np.concatenate([np.arange(dim), j])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((np.full(len(i), dim), i, j, np.full(len(i), n), high, low), fields.types, strict=True)], schema=fields)

    return table.select("embedding").mapInArrow(scatter, SUMS).groupBy("dim", "i", "j").agg(*[
        F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")])


class Whitening:
    """Components of one fit list: offsets and axes, and the figures that go with them."""

    def __init__(self, n, sums, products, components):
        dim = len(sums)
        self.n, self.sums = n, sums
        # n * n times the covariance, in whole numbers: centred before anything is rounded.
        centred = n * products - np.outer(sums, sums)
        covariance = np.array([[float(Fraction(int(c), n * n)) for c in row] for row in centred])
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1], axes[:, ::-1]
        self.count = min(components, dim)
        trace = float(Fraction(int(sum(centred[d, d] for d in range(dim))), n * n))
        flat = values <= ROUNDING * dim * max(values[0], 0)
        self.spread = np.where(flat, np.nan, np.sqrt(np.where(flat, 1, values)))[:self.count]
        self.axes = axes[:, :self.count]
        self.explained = np.where(flat, 0, values)[:self.count] / trace if trace else np.zeros(self.count)
        scaled = (self.axes / self.spread)[:, ~flat[:self.count]]
        error = scaled.T @ covariance @ scaled - np.eye(scaled.shape[1])
        self.identity_error = float(np.abs(error).max(initial=0))

    def deviations(self, matrix):
        """Exact sums of squares of ``n * x - sums`` per row; None beyond 64 bits."""
        largest = int(np.abs(matrix).max(initial=0)) * self.n + max(abs(int(s)) for s in self.sums)
        if math.isqrt((1 << 62) // matrix.shape[1]) > largest:
            apart = self.n * matrix - self.sums.astype(np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = self.n * matrix.astype(object) - self.sums
        return [int(d) if d < 1 << 63 else None for d in (apart * apart).sum(axis=1)]

    def project(self, matrix):
        """Whitened coordinates per row; NaN along components without spread."""
        mean = np.array([float(Fraction(int(s), self.n)) for s in self.sums])
        return (matrix - mean) @ self.axes / self.spread


def fit(table: DataFrame, components: int, scale: int) -> dict[int, Whitening]:
    """A ``Whitening`` per dimension, from the finite vectors of ``(embedding)``.

    Every task reduces its vectors to their exact sums and cross-products; what
    comes to the driver is one number per pair of dimensions.
    """
    sums = {}
    for r in _sums(table, scale).collect():  # a row per pair of dimensions
        sums.setdefault(r.dim, []).append((r.i, r.j, int(r.n), (int(r.high) << HALF) + int(r.low)))
    found = {}
    for dim, rows in sums.items():
        products, totals = np.zeros((dim, dim), object), np.zeros(dim, object)
        for i, j, _, value in rows:
            if i < 0:
                totals[j] = value
            else:
                products[i, j] = products[j, i] = value
        found[dim] = Whitening(rows[0][2], totals, products, components)
    return found


def whiten(table: DataFrame, components: int, scale: int = 64) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of ``(vec_id, embedding)``.

    Vectors that are null or hold a null or non-finite entry are left out, as
    are empty ones. An entry ``c`` becomes ``floor(scale * c) + OFFSET`` (at
    most ``LIMIT`` in size before the offset). Vectors of each dimension are a
    fit list of their own; repeated rows and null ids count as they stand.
    Covariances have divisor ``n`` and are taken from whole numbers. Components
    are numbered by falling eigenvalue, up to ``components``. Along one without
    spread, as where all vectors are equal, ``whitened`` is null and
    ``explained`` 0, and it is left out of ``identity_error``: the largest
    entry by which the covariance of the whitened rows, which is that of the
    vectors under the fitted axes, differs from the identity. ``deviation`` is
    exact, and null where it needs more than 64 bits.
    """
    rows = pick(table, "vec_id", "embedding")
    models = rows.sparkSession.sparkContext.broadcast(fit(rows, components, scale))  # a matrix per dimension
    fields = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(batches):
        for batch in batches:
            for at, matrix in vectors(batch.column(1), scale):
                model = models.value[matrix.shape[1]]
                for start in range(0, len(matrix), ROWS):
                    part, k = matrix[start:start + ROWS], model.count
                    ids = batch.column(0).take(pa.array(at[start:start + ROWS]))
                    each, along = np.repeat(np.arange(len(part)), k), np.tile(np.arange(k), len(part))
                    whitened = model.project(part).ravel()
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(each)), pa.array(along + 1, pa.int32()), pa.array(np.full(len(each), model.n)),
                        pa.array(model.deviations(part), pa.int64()).take(pa.array(each)), pa.array(whitened, pa.float64(), mask=np.isnan(whitened)),
                        pa.array(model.explained[along]), pa.array(np.full(len(each), model.identity_error))], schema=fields)

    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(
        project, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
