"""Arithmetic on arrays of numbers."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column of a table or a batch as one array."""
    if not isinstance(column, pa.ChunkedArray):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


@dataclass
class Vectors:
    """Vectors of a batch: lengths (-1: null, or with a null component), values one after the other, and their starts."""

    lengths: np.ndarray
    starts: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.lengths)

    def part(self, first: int, n: int) -> Vectors:
        return Vectors(self.lengths[first : first + n], self.starts[first : first + n], self.values)

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        """Their components, one row for each component."""
        return np.ascontiguousarray(self.values[self.starts[at][:, None] + np.arange(width)].T)

    def _each(self, other: Vectors, of) -> tuple[np.ndarray, np.ndarray]:
        found, known = np.zeros((len(self), len(other))), np.zeros((len(self), len(other)), dtype=bool)
        with np.errstate(all="ignore"):
            for width in np.intersect1d(self.lengths, other.lengths):
                if width < 0:
                    continue
                i, j = (np.flatnonzero(x.lengths == width) for x in (self, other))
                values, there = of(self.rows(i, width), other.rows(j, width))
                if len(i) == len(self) and len(j) == len(other):
                    return values, there
                found[np.ix_(i, j)], known[np.ix_(i, j)] = values, there
        return found, known

    def dots(self, other: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """dot() of each pair, to the last bit as components are added in order, and where it isn't null."""

        def of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            total = products_in_order(a, b)
            return total, np.ones(total.shape, dtype=bool)

        return self._each(other, of)

    def cosines(self, other: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """cosine() of each pair, to the last bit, and where it isn't null."""

        def of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = np.multiply.outer(*(np.sqrt(sum((c * c for c in x), np.zeros(x.shape[1]))) for x in (a, b)))
            return products_in_order(a, b) / size, size != 0

        return self._each(other, of)


def products_in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of columns of a and b, added in the order of the rows."""
    total = np.zeros((a.shape[1], b.shape[1]))
    one = np.empty_like(total)
    for x, y in zip(a, b):
        np.multiply.outer(x, y, out=one)
        total += one
    return total


def vectors_of(column: pa.Array | pa.ChunkedArray) -> Vectors:
    column = flat(column)
    lengths = pc.list_value_length(column).cast(pa.int64()).fill_null(-1).to_numpy()
    sizes = np.maximum(lengths, 0)
    starts, parts = np.cumsum(sizes) - sizes, column.flatten().cast(pa.float64())
    if parts.null_count:
        owner = np.repeat(np.arange(len(lengths)), sizes)
        bare = ~parts.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(np.bincount(owner[bare], minlength=len(lengths)) > 0, -1, lengths)
    return Vectors(lengths, starts, parts.fill_null(0.0).to_numpy())


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: half up in decimal digits of the shortest form. Only numbers close to a half, or so large that
    doubles don't tell, are looked at in decimal."""
    with np.errstate(all="ignore"):
        size = np.abs(x) * 10.0**digits
        out = np.copysign(np.floor(size + 0.5) / 10.0**digits, x) + 0.0
        unsure = np.isfinite(x) & ((np.abs(size - np.floor(size) - 0.5) < 1e-7) | (size >= 1e8))
    to, how = Decimal(1).scaleb(-digits), Context(prec=700)
    for at in zip(*np.nonzero(unsure)):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(to, ROUND_HALF_UP, how)) + 0.0
    return out
