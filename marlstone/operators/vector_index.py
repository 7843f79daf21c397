"""A vector index of product quantisation codes: tables look distances up, and exact ones decide among the best.

A vector of unit length is cut into parts, and each part is kept as the number of its nearest of up to 256 centres: one
byte a part, so a search reads a byte for each part where it would read 4 for each component."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine


@dataclass
class VectorIndex:
    """codes: vec_id, code (a byte for each part); centres: parts x centres x width."""

    codes: DataFrame
    centres: np.ndarray


def directions(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def nearest_centres(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows with a vector whose components are numbers and not all zero."""
    some = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "embedding").where(some & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def fitted(vectors: DataFrame, parts: int, centres: int = 256, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Centres of each part by k-means over a bounded sample, the `sample` vectors of least hash of their id. One task fits."""
    some = usable(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").repartition(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [directions(b.column(0)) for b in batches if b.num_rows]
        rows = np.concatenate(held) if held else np.zeros((0, parts))
        for p, part in enumerate(np.split(rows, parts, axis=1)):
            book = part[:centres].copy()
            for _ in range(rounds if len(book) else 0):
                at = nearest_centres(part, book)
                total, n = np.zeros_like(book), np.bincount(at, minlength=len(book))
                np.add.at(total, at, part)
                book[n > 0] = total[n > 0] / n[n > 0, None]
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([book.tobytes()], pa.binary()), pa.array([len(book)])], ["part", "book", "n"])

    found = sorted(some.mapInArrow(fit, "part long, book binary, n long").collect())
    if not sum(r["n"] for r in found):
        return np.zeros((parts, 0, 0))
    return np.stack([np.frombuffer(r["book"]).reshape(r["n"], -1) for r in found])


def write_index(vectors: DataFrame, folder: str, parts: int = 16) -> VectorIndex:
    """Fits centres, writes the codes of every usable row, and the centres, in place of an older index, and reads it back.

    The number of components must be a multiple of parts. Rows without a direction aren't in the index."""
    centres = fitted(vectors, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cut = np.split(directions(batch.column(1)), parts, axis=1)
                code = np.stack([nearest_centres(x, c) for x, c in zip(cut, centres)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary())], ["vec_id", "code"])

    usable(vectors).mapInArrow(run, "vec_id long, code binary").write.mode("overwrite").parquet(f"{folder}/codes")
    spark = vectors.sparkSession
    rows = [(p, i, c.tolist()) for p, book in enumerate(centres) for i, c in enumerate(book)]
    spark.createDataFrame(rows, "part int, centre int, components array<double>").write.mode("overwrite").parquet(f"{folder}/centres")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> VectorIndex:
    rows = spark.read.schema("part int, centre int, components array<double>").parquet(f"{folder}/centres").orderBy("part", "centre").collect()
    parts = 1 + max((r["part"] for r in rows), default=-1)
    listed = np.array([r["components"] for r in rows]).reshape(parts, len(rows) // max(parts, 1), -1) if rows else np.zeros((0, 0, 0))
    return VectorIndex(spark.read.schema("vec_id long, code binary").parquet(f"{folder}/codes"), listed)


def nearest(index: VectorIndex, queries: DataFrame, vectors: DataFrame, k: int = 5, rerank: int = 50, at_once: int = 256) -> DataFrame:
    """query_id, vec_id, cos, rank: nearly the k nearest other vectors of each of a stated set of queries (vec_id, embedding).

    Each task looks up, for every query, the sum over parts of the query's products with the centres, and keeps the
    rerank best of each batch; of all these, the rerank best of a query are read as vectors and ranked exactly. Queries
    go in blocks of at_once, each block a pass over the codes."""
    asked = usable(queries).orderBy("vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    t = asked.toArrow()  # the stated set, a few numbers for each query
    ids, at = t.column(0).to_numpy(), directions(t.column(1).combine_chunks()) if t.num_rows else np.zeros((0, 1))
    found = index.codes.sparkSession.createDataFrame([], "query_id long, vec_id long, about double")
    for a in range(0, len(ids), at_once):
        some = ids[a : a + at_once]
        cut = np.split(at[a : a + at_once], len(index.centres), axis=1)
        tables = np.stack([x @ c.T for x, c in zip(cut, index.centres)], axis=1).astype(np.float32)  # query, part, centre

        def run(batches: Iterator[pa.RecordBatch], some=some, tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vec = batch.column(0).to_numpy()
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(vec), -1)
                best = min(len(vec), rerank + 1)  # one may be the query itself
                for q, table in zip(some, tables):
                    about = table[np.arange(code.shape[1]), code].sum(axis=1)
                    top = np.argpartition(-about, best - 1)[:best]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(best, q)), pa.array(vec[top]), pa.array(about[top].astype(np.float64))], ["query_id", "vec_id", "about"])

        found = found.unionByName(index.codes.mapInArrow(run, "query_id long, vec_id long, about double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id")
    chosen = found.where("vec_id <> query_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= rerank)
    read = chosen.select("query_id", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id").join(asked, "query_id")
    exact = read.select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("cos"))
    best = Window.partitionBy("query_id").orderBy(F.desc("cos"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
