"""Vector code compression: product codes whose nearest entries are found by equal-average search.

Components become integers, so every sum, mean and distance is exact and no result depends on the order of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers are held within this, so that 64 bits hold the sums; with SCALE that is a component of 65,536.
LARGEST = 1 << 26


def equal_average_search(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of part (squared Euclidean distance, ties to the lower index), and the distance.

    Entries are sorted by component sum. From its own sum each row goes outward on both sides. By Cauchy and Schwarz a
    distance is at least the squared gap of the sums over the dimension, so a side ends where that strictly exceeds the
    best distance so far: entries that tie with it are still seen."""
    n, width = part.shape
    order = np.argsort(entries.sum(axis=1), kind="stable")
    listed, sums, own = entries[order], entries.sum(axis=1)[order], part.sum(axis=1)
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    start = np.searchsorted(sums, own)
    sides = [(np.arange(n), start - 1, -1), (np.arange(n), start, 1)]
    while any(len(rows) for rows, _, _ in sides):
        for s, (rows, at, step) in enumerate(sides):
            inside = (at >= 0) & (at < len(sums))
            rows, at = rows[inside], at[inside]
            gap = own[rows] - sums[at]
            # best is the largest number before the first look, which no product may exceed
            near = (best[rows] == np.iinfo(np.int64).max) | (gap * gap <= np.minimum(best[rows], 1 << 56) * width)
            rows, at = rows[near], at[near]
            away = part[rows] - listed[at]
            found = np.einsum("ij,ij->i", away, away)
            better = (found < best[rows]) | ((found == best[rows]) & (order[at] < index[rows]))
            best[rows[better]], index[rows[better]] = found[better], order[at[better]]
            sides[s] = rows, at + step, step
    return index, best


def whole(vectors: DataFrame, embedding: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that have a vector, and its dimension: the greatest length of all.

    Left out are null vectors, those with a null or non-finite component, and shorter ones than the longest."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = vectors.where(F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: F.coalesce(bad(x), F.lit(True))))
    dimension = kept.agg(F.max(F.size(embedding))).first()[0] or 0
    return kept.where(F.size(embedding) == dimension), dimension


def integers(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(len(column), dimension)


def cut(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal consecutive parts of each row; components that are left over at the end belong to none."""
    width = rows.shape[1] // parts
    return [rows[:, p * width : (p + 1) * width] for p in range(parts)]


def train_codebooks(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> list[np.ndarray]:
    """A codebook (entries x width integers) for each part position.

    They start as the parts of the vectors of the least keys (nulls last, equal keys by their vectors; fewer rows make
    fewer entries). Each round assigns all rows, adds up their parts by entry, in each task first, and puts the floor of
    the mean in place of each entry; unused ones stay. The driver gets one sum for each component of the codebooks,
    whatever the number of rows. See whole() for the rows that count; without any there are no entries."""
    kept, dimension = whole(vectors.select(key, embedding), embedding)
    width = dimension // parts
    first = [r[0] for r in kept.orderBy(F.col(key).asc_nulls_last(), embedding).limit(entries).select(embedding).collect()]
    start = integers(pa.array(first, pa.list_(pa.float64())), dimension)
    books = [p.copy() for p in cut(start, parts)]
    size = len(first) * width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, len(first), width), dtype=np.int64), np.zeros((parts, len(first)), dtype=np.int64)
        for part in common.slices(batches, 4096):
            for p, rows in enumerate(cut(integers(part.column(0), dimension), parts)):
                index, _ = equal_average_search(rows, books[p])
                np.add.at(total[p], index, rows)
                count[p] += np.bincount(index, minlength=len(first))
        some = np.repeat(count > 0, width)
        out = [np.arange(parts * size)[some], total.ravel()[some], np.repeat(count, width)[some]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["slot", "total", "n"])

    for _ in range(rounds if size else 0):
        found = kept.select(embedding).mapInArrow(sums, "slot long, total long, n long")
        for r in found.groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            p, rest = divmod(r["slot"], size)
            books[p][rest // width, rest % width] = r["total"] // r["n"]
    return books


def encoded(vectors: DataFrame, books: list[np.ndarray], embedding: str = "embedding") -> DataFrame:
    """The rows of vectors that whole() keeps, with code (array of an entry's number for each part) and error (long: the
    squared distance in integers, summed over parts). Columns of those names are replaced, others stay; repeated rows
    are rows of their own."""
    kept, dimension = whole(vectors, embedding)
    kept = kept.drop("code", "error")
    names = kept.columns
    at = [c.lower() for c in names].index(embedding.lower())
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "code array<int>", "error long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 4096):
            found = [equal_average_search(rows, book) for rows, book in zip(cut(integers(part.column(at), dimension), len(books)), books)]
            code = np.stack([i for i, _ in found], axis=1).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * len(books)), pa.array(code.ravel()))
            error = pa.array(np.sum([e for _, e in found], axis=0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns, listed, error], [*names, "code", "error"])

    return kept.mapInArrow(run, schema)


def decoded(code: Column, books: list[np.ndarray]) -> Column:
    """The vector that a code stands for: its entries' components side by side, by SCALE."""
    tables = [F.array(*(F.array(*(F.lit(int(x) / SCALE) for x in entry)) for entry in book)) for book in books]
    return F.flatten(F.array(*(F.get(t, F.get(code, p)) for p, t in enumerate(tables))))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their product codes, by train_codebooks and encoded: see there and in whole() for nulls, empty
    vectors, ties, repeated rows, empty tables and other columns. Components beyond 65,536 count as that."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = train_codebooks(vectors)
    entries = ",".join(str(x) for book in books for x in book.ravel().tolist())
    rows = common.saved(encoded(vectors, books).drop("embedding"))
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    hexed = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", hexed.alias("code"), "error", "label_error", F.lit(hashlib.sha256(entries.encode()).hexdigest()).alias("codebooks_sha256")
    )


def _sql() -> str:
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) r(p))",
        "b0 AS (SELECT p, e, x AS y FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256)",
    ]
    nearest = """a{i} AS (SELECT vec_id, label, p, any_value(x) AS x, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM
  (SELECT vec_id, label, parts.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - y[j]) * (x[j] - y[j])))::BIGINT AS d FROM parts JOIN b{i} ON parts.p = b{i}.p)
  GROUP BY vec_id, label, p)"""
    mean = """s{i} AS (SELECT p, e, list(m ORDER BY j) AS y FROM (SELECT p, e, j, floor(sum(x[j]) / count(*))::BIGINT AS m FROM a{i}, (SELECT unnest(range(1, 17)) AS j) GROUP BY ALL) GROUP BY p, e),
b{n} AS (SELECT p, e, coalesce(s{i}.y, b{i}.y) AS y FROM b{i} LEFT JOIN s{i} USING (p, e))"""
    for i in range(ROUNDS):
        steps += [nearest.format(i=i), mean.format(i=i, n=i + 1)]
    steps += [
        nearest.format(i=ROUNDS),
        f"books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})",
        f"found AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM found, books"


#: For vectors of 64 components, as the given table has.
OP13_SQL = _sql()
