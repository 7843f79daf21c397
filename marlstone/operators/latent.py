"""Vectors of texts: hashed counts of words and pairs of words, weighted by rarity, and their leading singular directions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import written


@dataclass
class LatentSpace:
    """idf: a weight for each feature; basis: features x rank, orthonormal columns; values: singular values, descending."""

    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray


def features(text: Column, width: int) -> Column:
    """The hashed feature (0 to width - 1) of each token and each pair of neighbours; an empty array for null texts."""

    def hashed(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.transform(F.concat(words, pairs), lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))

    return F.transform(F.array(F.coalesce(tokens(text), F.array().cast("array<string>"))), hashed)[0]


def places(column: pa.Array, width: int, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of rows at a time of a column of features: how many, the places (row * width + feature, ascending) that occur, and how often."""
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        owner = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
        counts = np.bincount(owner * width + part.flatten().to_numpy(zero_copy_only=False), minlength=len(part) * width)
        full = np.flatnonzero(counts)
        yield len(part), full, counts[full]


def dense(n: int, place: np.ndarray, counts: np.ndarray, idf: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
    """n rows of unit length (or zero): 1 + log of a count, times idf; into, if given, holds zeros and is written to."""
    owner, feature = np.divmod(place, len(idf))
    weight = (1 + np.log(counts)) * idf[feature]
    size = np.sqrt(np.bincount(owner, weight * weight, minlength=n))
    x = np.zeros(n * len(idf)) if into is None else into[: n * len(idf)]
    x[place] = weight / np.maximum(size, 1e-300)[owner]
    return x.reshape(n, -1)


def weighted(column: pa.Array, idf: np.ndarray, rows: int = 256) -> Iterator[np.ndarray]:
    """dense() rows of a column of features, rows at a time."""
    return (dense(*found, idf) for found in places(column, len(idf), rows))


def counted(df: DataFrame, width: int = 4096, text: str = "text") -> DataFrame:
    """df without text, and found and times: a text's distinct features, ascending, and how often each occurs, of four bytes each."""
    rest = df.drop(text)
    names = [*rest.columns, "found", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for n, place, counts in places(part.column(part.num_columns - 1), width):
                    ends = np.searchsorted(place, np.arange(1, n) * width)
                    cut = ([x.tobytes() for x in np.split(y.astype("<i4"), ends)] for y in (place % width, counts))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(x, pa.binary()) for x in cut)], names)

    binary = F.lit(None).cast("binary")
    schema = rest.withColumns({"found": binary, "times": binary}).schema
    return df.select(*rest.columns, features(F.col(text), width).alias("_found")).mapInArrow(run, schema)


def places_in(found: pa.Array, times: pa.Array, width: int, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """places() of the columns of counted()."""
    for at in range(0, len(found), rows):
        held = found.slice(at, rows).to_pylist()
        owner = np.repeat(np.arange(len(held)), [len(x) // 4 for x in held])
        counts = np.frombuffer(b"".join(times.slice(at, rows).to_pylist()), dtype="<i4")
        yield len(held), owner * width + np.frombuffer(b"".join(held), dtype="<i4"), counts


def times_gram(found: DataFrame, idf: np.ndarray, basis: np.ndarray, block: int = 256) -> np.ndarray:
    """AᵀA times basis, for the matrix A of all rows of counted(): each task adds up its rows, Spark adds up the tasks' sums
    block by block of features, and the driver gets one matrix of the size of basis."""
    width, rank = basis.shape
    told = found.sparkSession.sparkContext.broadcast((idf, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = told.value
        total, product = np.zeros((width, rank)), np.empty((width, rank))
        held = np.zeros(256 * width)  # memory that is asked for anew for each block costs as much as the products
        for batch in batches:
            for part in places_in(batch.column(0), batch.column(1), width):
                x = dense(*part, idf, held)
                total += np.matmul(x.T, x @ basis, out=product)
                held[part[1]] = 0
        starts = range(0, width, block)
        yield pa.RecordBatch.from_arrays([pa.array(list(starts)), pa.array([total[s : s + block].tobytes() for s in starts], pa.binary())], ["start", "sums"])

    def add(table: pa.Table) -> pa.Table:
        held = sorted(table.column("sums").to_pylist())  # in an order of their own, so that sums don't depend on arrival
        total = sum((np.frombuffer(s) for s in held[1:]), np.frombuffer(held[0]).copy())
        return pa.table({"start": table.column("start").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "start long, sums binary"
    parts = found.select("found", "times").mapInArrow(run, schema).groupBy("start").applyInArrow(add, schema).collect()
    told.destroy()
    out = np.zeros((width, rank))
    for r in parts:
        out[r["start"] : r["start"] + block] = np.frombuffer(r["sums"]).reshape(-1, rank)
    return out


def rows_with(found: DataFrame, width: int) -> np.ndarray:
    """How many rows of counted() have each feature; a task sends one sum for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 256).to_pylist()), dtype="<i4"), minlength=width)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["feature", "n"])

    out = np.zeros(width)
    for r in found.select("found").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most width
        out[r["feature"]] = r["n"]
    return out


def fitted(texts: DataFrame, rank: int = 64, width: int = 4096, rounds: int = 6, extra: int = 16, seed: int = 7) -> LatentSpace:
    """The space of fitted_on() of all texts (column text), which are cut into tokens once."""
    return fitted_on(written(counted(texts.select("text"), width)), rank, width, rounds, extra, seed)


def fitted_on(found: DataFrame, rank: int = 64, width: int = 4096, rounds: int = 6, extra: int = 16, seed: int = 7) -> LatentSpace:
    """The leading singular directions of all rows of a table of counted(), by subspace iteration over the whole table.

    A round is a pass over the table; the driver holds matrices of width x (rank + extra) numbers, whatever the table's size.
    Signs are fixed: a direction's greatest component is positive. With fewer directions than rank the rest have the value 0."""
    # each task of a pass sends a matrix, so tasks are as many as the cores ask for, not as the table has files
    found = found.coalesce(2 * found.sparkSession.sparkContext.defaultParallelism)
    total, seen = found.count(), rows_with(found, width)
    idf = np.where(seen > 0, np.log((1 + total) / (1 + seen)) + 1, 0.0)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(rank + extra, width))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(times_gram(found, idf, basis))[0]
    # the directions within the subspace: eigenvectors of the small matrix Bᵀ AᵀA B
    small = basis.T @ times_gram(found, idf, basis)
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-squares)[:rank]
    basis = basis @ turn[:, order]
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    return LatentSpace(idf, basis, np.sqrt(np.maximum(squares[order], 0.0)))


def embedded(df: DataFrame, space: LatentSpace, text: str = "text") -> DataFrame:
    """Adds embedding: a text's coordinates in the space, of unit length; null for texts without any known feature (null
    and empty ones too). Equal texts have equal vectors. A column of that name is replaced; other columns and rows stay."""
    told = df.sparkSession.sparkContext.broadcast(space)
    rest = df.drop("embedding")
    names = [*rest.columns, "embedding"]
    carried = rest.withColumn("_found", features(F.col(text), len(space.idf)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = told.value
        for batch in batches:
            blocks = weighted(batch.column(batch.num_columns - 1), space.idf)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], coordinates(blocks, space)], names)

    return carried.mapInArrow(run, rest.withColumn("embedding", F.lit(None).cast("array<double>")).schema)


def embedded_on(found: DataFrame, space: LatentSpace) -> DataFrame:
    """The columns of counted() but found and times, and embedding, as embedded() has it."""
    told = found.sparkSession.sparkContext.broadcast(space)
    rest = found.drop("found", "times")
    names = [*rest.columns, "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = told.value
        for batch in batches:
            blocks = (dense(*part, space.idf) for part in places_in(*batch.columns[-2:], len(space.idf)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], coordinates(blocks, space)], names)

    return found.select(*rest.columns, "found", "times").mapInArrow(run, rest.withColumn("embedding", F.lit(None).cast("array<double>")).schema)


def coordinates(blocks: Iterator[np.ndarray], space: LatentSpace) -> pa.Array:
    """The rows of dense() blocks in the space, of unit length; null if they have no length there."""
    parts = [x @ space.basis for x in blocks]
    at = np.concatenate(parts) if parts else np.zeros((0, space.basis.shape[1]))
    size = np.linalg.norm(at, axis=1)
    unit, some = at / np.maximum(size, 1e-300)[:, None], size > 1e-12
    starts = np.concatenate([[0], np.cumsum(np.where(some, at.shape[1], 0))])
    values = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(unit[some].reshape(-1)))
    return pc.if_else(pa.array(some), values, pa.nulls(len(some), values.type))
