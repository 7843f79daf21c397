"""Similarity join of vectors: links are counted over all pairs, block by block in tasks; similar pairs themselves are found by
bucketed random projections and verified exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, flat
from ..sources.shared import written
from .vector_index import directions, usable


def distinct_directions(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives (vec_id: the least of equal vectors, embedding) and membership (vec_id, representative) of the rows
    that have a direction. Rows count once for each vec_id and vector; null ids are left out."""
    rows = usable(vectors.where("vec_id is not null"))
    least = digested(rows, True).groupBy("_digest").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("representative"))
    members = digested(rows, False).distinct().join(least.select("_digest", "representative"), "_digest")
    return least.select(F.col("representative").alias("vec_id"), "embedding"), members.select("vec_id", "representative")


def digested(rows: DataFrame, whole: bool) -> DataFrame:
    """vec_id, _digest (SHA-256 of the components' bytes), and embedding if whole."""
    kept = [0, 1][: 1 + whole]
    names = [rows.columns[c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            digests = [hashlib.sha256(numbers[a:b]).digest() for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(digests, pa.binary())], [*names, "_digest"])

    return rows.mapInArrow(run, rows.select(*names).withColumn("_digest", F.lit(None).cast("binary")).schema)


#: Components are kept as whole numbers of two bytes, and planes in steps, so that projections are exact in doubles.
STEPS, FINE = 32767, 1 << 20


def planes(width: int, tables: int, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Directions (width x tables x bits) and offsets (tables x bits, 0 to 1) of the projections; the same for a seed."""
    made = np.random.default_rng(seed)
    return np.round(made.standard_normal((width, tables, bits)) * FINE), made.random((tables, bits))


def keys_of(codes: np.ndarray, way: np.ndarray, shift: np.ndarray, cell: float) -> np.ndarray:
    """The number of the bucket of each row of codes in each table: the same wherever it is worked out, as sums are exact.

    A bucket is the product of intervals of length cell, one on each of the table's projections."""
    place = np.floor(np.tensordot(codes.astype(np.float64), way, axes=1) / (STEPS * FINE * cell) + shift).astype(np.int64)
    mix = np.zeros(place.shape[:2], dtype=np.uint64)
    for b in range(place.shape[2]):  # a collision only makes another candidate
        mix = (mix ^ place[:, :, b].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    return mix.view(np.int64)


def coded(rows: DataFrame) -> DataFrame:
    """vec_id, code: two bytes for each component of the vector of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = np.round(directions(batch.column(1)) * STEPS).astype("<i2")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "code"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, code binary")


def codes_in(column: pa.Array) -> np.ndarray:
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), dtype="<i2").reshape(len(held), -1)


def in_buckets(rows: DataFrame, cell: float, tables: int, bits: int, turn: range, codes: bool) -> DataFrame:
    """table, key, vec_id (and code, if asked for) of each row of coded() in each table of the turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                held = codes_in(part.column(1))
                way, shift = planes(held.shape[1], tables, bits)
                keys = keys_of(held, way[:, turn.start : turn.stop], shift[turn.start : turn.stop], cell)
                owner = pa.array(np.repeat(np.arange(len(held)), len(turn)))
                out = [pa.array(np.tile(np.arange(turn.start, turn.stop, dtype=np.int32), len(held))), pa.array(keys.reshape(-1)), part.column(0).take(owner)]
                yield pa.RecordBatch.from_arrays([*out, part.column(1).take(owner)][: 3 + codes], ["table", "key", "vec_id", "code"][: 3 + codes])

    return rows.mapInArrow(run, "table int, key long, vec_id long" + ", code binary" * codes)


def tables_for(recall: float, bits: int, spread: float) -> int:
    """How many tables bring a pair at the threshold together with this probability, where an interval is `spread` times as
    long as their distance: projections of such a pair differ by a normal variable of that distance."""
    outside = math.erfc(spread / math.sqrt(2))
    p = 1 - outside - 2 / (math.sqrt(2 * math.pi) * spread) * (1 - math.exp(-(spread**2) / 2))
    return math.ceil(math.log(1 - recall) / math.log(1 - p**bits))


def met(rows: DataFrame, cos: float, recall: float, bits: int, spread: float, block: int, at_once: int = 8) -> DataFrame:
    """a, b (a < b), sure: pairs of coded() rows that share a bucket and whose codes don't rule a cosine of cos or more out;
    sure if the codes alone show it. Each pair once.

    Tables have their turns, at_once of them, and a turn's pairs are written before the next: only so many copies of the
    codes are on disk. A task has rows sorted by bucket, compares each bucket's, and keeps what meets first in its table,
    which the codes tell."""
    cell, tables = spread * math.sqrt(max(2 - 2 * cos, 1e-12)), tables_for(recall, bits, spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        left = None

        def pairs(at: np.ndarray, held: np.ndarray, width: int) -> Iterator[tuple]:
            """Places i, j and whether sure, for runs of equal length (rows of at), which are buckets."""
            slack = math.sqrt(width) / STEPS * (1 + math.sqrt(width) / STEPS) + 1e-9
            size = at.shape[1]
            step = min(size, max(1, 2_000_000 // size))
            many = max(1, 2_000_000 // (step * size + size * width))
            for r in range(0, len(at), many):
                whole = held[at[r : r + many]]
                for s in range(0, size, step):
                    found = whole[:, s : s + step] @ whole.transpose(0, 2, 1) / STEPS**2
                    which, i, j = np.nonzero(found >= cos - slack)
                    keep = i + s < j
                    which, i, j = which[keep], i[keep], j[keep]
                    yield at[r + which, i + s], at[r + which, j], found[which, i, j] >= cos + slack

        def worked(part: pa.Table) -> Iterator[pa.RecordBatch]:
            table, key, low, high, own, name = (part.column(c).to_numpy() for c in ("table", "key", "low", "high", "own", "vec_id"))
            new = (np.diff(table) != 0) | (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            sizes = np.diff(np.concatenate([starts, [len(table)]]))
            if sizes.max() < 2:
                return
            codes = codes_in(flat(part.column("code")))
            width, held = codes.shape[1], codes.astype(np.float64)
            way, shift = made.setdefault(width, planes(width, tables, bits) if width not in made else None)
            for size in np.unique(sizes[sizes > 1]):
                for i, j, sure in pairs(starts[sizes == size][:, None] + np.arange(size), held, width):
                    # two rows of one block meet in its own cell only, and two of different blocks in the cell of both
                    keep = ((own[i] != own[j]) | (low[i] == high[i])) & (name[i] != name[j])
                    i, j, sure = i[keep], j[keep], sure[keep]
                    for s in range(0, len(i), 20_000):
                        x, y = i[s : s + 20_000], j[s : s + 20_000]
                        some, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                        keys = np.concatenate([keys_of(codes[some[k : k + 500]], way, shift, cell) for k in range(0, len(some), 500)])
                        first = (keys[back[: len(x)]] == keys[back[len(x) :]]).argmax(axis=1) == table[x]
                        a, b = name[x[first]], name[y[first]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure[s : s + 20_000][first])], ["a", "b", "sure"])

        for batch in batches:
            part = pa.Table.from_batches([batch])
            if left is not None:
                part = pa.concat_tables([left, part])
            # the last bucket may go on in the next batch
            last = np.ones(part.num_rows, dtype=bool)
            for c in ("table", "key", "low", "high"):
                x = part.column(c).to_numpy()
                last &= x == (x[-1] if len(x) else 0)
            cut = part.num_rows - int(last.sum())
            if cut:
                yield from worked(part.slice(0, cut))
            left = part.slice(cut)
        if left is not None and left.num_rows:
            yield from worked(left)

    parts, names = [], ["table", "key", "low", "high"]
    for start in range(0, tables, at_once):
        turn = range(start, min(start + at_once, tables))
        sizes = in_buckets(rows, cell, tables, bits, turn, False).groupBy("table", "key").agg(F.count("*").alias("n"))
        # of 2,000 and more rows each, so few
        large = written(sizes.where(F.col("n") > block).select("table", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
        dealt = in_buckets(rows, cell, tables, bits, turn, True).join(F.broadcast(large), ["table", "key"], "left")
        dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        others = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        celled = others.select("table", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "vec_id", "code")
        sought = celled.repartition(*names).sortWithinPartitions(*names)
        parts.append(written(sought.mapInArrow(run, "a long, b long, sure boolean")))
        # what the turn shuffled goes when the driver's JVM finds that nothing refers to it
        rows.sparkSession._jvm.System.gc()
    return reduce(DataFrame.unionByName, parts)


def with_cos(pairs: DataFrame, representatives: DataFrame, cos: float) -> DataFrame:
    """a, b, cos of the pairs whose cosine is cos or more, by their whole vectors."""
    size = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    unit = representatives.select("vec_id", F.transform("embedding", lambda x: x.cast("double") / size).alias("unit"))
    side = lambda key, to: unit.select(F.col("vec_id").alias(key), F.col("unit").alias(to))
    found = pairs.select("a", "b").join(side("a", "ea"), "a").join(side("b", "eb"), "b")
    return found.select("a", "b", dot(F.col("ea"), F.col("eb")).alias("cos")).where(F.col("cos") >= cos)


def similar_pairs(representatives: DataFrame, cos: float = 0.8, recall: float = 0.95, bits: int = 8, spread: float = 3.0, block: int = 2000) -> DataFrame:
    """a, b, cos (a < b): pairs of different vectors whose cosine is cos or more.

    Precise, with an expected recall: a pair is found if all its projections agree in one of the tables, of which there
    are enough for a pair at cos itself (see tables_for); closer pairs are found more often. A bucket of more than `block` rows, however
    large, is dealt into n blocks, and its rows go to n of the n (n + 1) / 2 pairs of blocks, so no task has to
    hold a bucket; all of its pairs are still verified. A pair counts in the first table that brings it together, so
    results need no distinct. All vectors must have one length; an empty table gives no pairs."""
    return with_cos(met(written(coded(representatives)), cos, recall, bits, spread, block), representatives, cos)


def linked_pairs(representatives: DataFrame, cos: float = 0.8, recall: float = 0.95, bits: int = 8, spread: float = 3.0, block: int = 2000) -> DataFrame:
    """a, b of similar_pairs: whole vectors are read only for pairs so close to cos that their codes don't decide."""
    found = met(written(coded(representatives)), cos, recall, bits, spread, block)
    return found.where("sure").select("a", "b").unionByName(with_cos(found.where("NOT sure"), representatives, cos).select("a", "b"))


def unit_rows(representatives: DataFrame, sizes: DataFrame) -> DataFrame:
    """vec_id, n (of sizes: representative, n), code: four bytes for each component of the vector of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = directions(batch.column(2)).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([u.tobytes() for u in units], pa.binary())], ["vec_id", "n", "code"])

    named = representatives.join(sizes.withColumnRenamed("representative", "vec_id"), "vec_id")
    return named.select("vec_id", F.col("n").cast("long"), "embedding").mapInArrow(run, "vec_id long, n long, code binary")


def counted(low: tuple, high: tuple | None, cos: float, tile: int = 512) -> Iterator[tuple]:
    """Arrays a, b, far for all pairs of a row of low and one of high, or of two rows of low where high is None.

    Where b is None, far is the sum of n over the rows whose cosine with a is cos or more for sure. Where it isn't, a and b
    are pairs (both ways) that four bytes a component leave open. A side is its names, its n, and its rows of unit length;
    rows of equal names don't make pairs."""
    own = high is None
    if own:
        order = np.argsort(low[0], kind="stable")
        low = high = tuple(x[order] for x in low)
    # what is lost by a product of rounded components, added in any order, and by one that is added in doubles
    slack, fine = (low[2].shape[1] + 4) * 2.0**-23, 2.0**-22
    # whole numbers, so sums are exact
    kind = np.float32 if max(low[1].sum(), high[1].sum()) < 1 << 24 else np.float64
    (ln, lw, lx), (hn, hw, hx) = ((names, n.astype(kind), rows) for names, n, rows in (low, high))
    lsum, hsum = np.zeros(len(ln), dtype=np.int64), np.zeros(len(hn), dtype=np.int64)
    for r in range(0, len(hn), tile // 2):
        rows = slice(r, r + tile // 2)
        for c in range(0, len(ln), tile):
            cols = slice(c, c + tile)
            if own and ln[c] >= hn[rows][-1]:
                break
            found = hx[rows] @ lx[cols].T
            if own and ln[cols][-1] >= hn[r]:
                found[hn[rows][:, None] <= ln[cols]] = -2
            sure, may = found >= np.float32(cos + slack), found >= np.float32(cos - slack)
            i, j = np.divmod(np.flatnonzero(may ^ sure), found.shape[1])
            for s in range(0, len(i), 20_000):
                x, y = i[s : s + 20_000], j[s : s + 20_000]
                about = (hx[r + x].astype(np.float64) * lx[c + y]).sum(axis=1)
                sure[x, y] = about >= cos + fine
                left = np.abs(about - cos) < fine
                a, b = hn[r + x[left]], ln[c + y[left]]
                if len(a):
                    yield np.concatenate([a, b]), np.concatenate([b, a]), np.zeros(2 * len(a), dtype=np.int64)
            hits = sure.astype(kind)
            hsum[rows] += (hits @ lw[cols]).astype(np.int64)
            lsum[cols] += (hw[rows] @ hits).astype(np.int64)
    for names, total in [(ln, lsum + hsum)] if own else [(ln, lsum), (hn, hsum)]:
        yield names[total > 0], None, total[total > 0]


def link_counts(rows: DataFrame, cos: float, block: int, least: int = 16) -> DataFrame:
    """a, b, far as counted() says them, for all pairs of rows of unit_rows(); b is null where it says None.

    A hash of their ids deals rows into blocks of about `block` rows, or into up to `least` smaller ones of 2,000 at least, so that
    there are tasks enough. Each pair of blocks is a partition: its task holds two blocks of rows, and no pairs."""
    total = rows.count()
    blocks = max(1, -(-total // block), min(least, -(-total // 2000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows:
                units = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<f4").reshape(batch.num_rows, -1)
                held.append((*(batch.column(c).to_numpy() for c in range(4)), units))
        if not held:
            return
        cell, side, *columns = (np.concatenate(x) for x in zip(*held))
        held.clear()
        for k in np.unique(cell):
            own, low, high = (tuple(x[(cell == k) & (side == at)] for x in columns) for at in (0, 1, 2))
            if len(own[0]):
                results = counted(own, None, cos)
            else:
                results = counted(low, high, cos) if len(low[0]) and len(high[0]) else ()
            for a, b, far in results:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(far)], ["a", "b", "far"])

    dealt = rows.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    high, low = F.greatest("own", "other"), F.least("own", "other")
    cell = (F.floor(high * (high + 1) / 2) + low).cast("int")
    side = F.when(high == low, 0).when(F.col("own") == low, 1).otherwise(2)
    celled = dealt.select(cell.alias("cell"), side.alias("side"), "vec_id", "n", "code")
    return celled.repartitionById(blocks * (blocks + 1) // 2, F.col("cell")).mapInArrow(run, "a long, b long, far long")


def similarity_join(vectors: DataFrame, cos: float = 0.8, block: int = 120_000) -> DataFrame:
    """vec_id, representative, links: for every row with a direction, the least id of equal vectors, and how many other ids
    have a cosine of cos or more (equal vectors included).

    Exact: all pairs of representatives are compared, in blocks, and only counts leave a task, as links may be nearly
    as many as pairs. The few pairs whose cosine is within 2^-22 of cos are decided by whole vectors in doubles. Time
    grows with the square of the representatives, and what is shuffled with their number times that of blocks."""
    representatives, members = map(written, distinct_directions(vectors))
    sizes = members.groupBy("representative").agg(F.count("*").alias("n"))
    found = written(link_counts(written(unit_rows(representatives, sizes)), cos, block))
    left = found.where("b is not null")
    close = with_cos(left, representatives.join(left.select(F.col("a").alias("vec_id")), "vec_id", "left_semi"), cos)
    decided = close.join(sizes.withColumnRenamed("representative", "b"), "b").select("a", F.col("n").alias("far"))
    linked = found.where("b is null").select("a", "far").unionByName(decided).groupBy(F.col("a").alias("representative")).agg(F.sum("far").alias("far"))
    own = sizes.join(linked, "representative", "left")
    total = own.select("representative", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return members.join(total, "representative").select("vec_id", "representative", "links")
