"""SimHash near-dedup: pivot distance tables discard pairs, bit by bit comparison verifies survivors.

Pivots alone are a weak index, as distances of unrelated fingerprints to a reference lie close together, so keys bring
pairs into one group: blocks of bits for fingerprints, prefix shingles for similar texts (see similar.py). Within a
group no pair is ever written out before its pivot distances and its fingerprints have been compared."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

ASCII = str.maketrans(common.UPPER, common.UPPER.lower())
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; fewer words make one shingle, none make none."""
    data = " ".join(WORD.findall(text.translate(ASCII))).encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(0, dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
    if len(gaps) + 1 < words:
        return np.array([xxhash.xxh64_intdigest(data, 42)], dtype=np.uint64)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)]
    h = xxhash.xxh64_intdigest
    return np.array([h(data[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], dtype=np.uint64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits; a bit is 1 if it is set in over half the shingles' hashes (repeats count); no words: zero."""
    h = shingle_hashes(text, shingle)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 255):
        bits = np.unpackbits(h[at : at + 255, None].view(np.uint8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (long) for every row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            fps = pa.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), fps], ["doc_id", "fp"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# --- pairs within groups --------------------------------------------------------------------------------------------


def references(count: int, longs: int, seed: int = 43) -> np.ndarray:
    r = random.Random(seed)
    return np.array([[r.getrandbits(64) for _ in range(longs)] for _ in range(count)], dtype=np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (rows of longs) to each reference fingerprint."""
    return np.stack([np.bitwise_count(fps ^ r).sum(axis=1, dtype=np.int16) for r in pivots], axis=1)


def survivors(
    group: np.ndarray,
    fps: np.ndarray,
    table: np.ndarray,
    most: np.ndarray,
    limit: Callable[[np.ndarray, np.ndarray], np.ndarray],
    told: dict | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row numbers) of one group whose fingerprints are at most limit(i, j) bits apart.

    Rows are sorted by group, and within it by the table's first column; most is the greatest limit a row has with any
    other. All pairs of a group whose first coordinates are that near are looked at, a lag at a time and never held; a
    pair whose greatest coordinate difference is above its limit is discarded, and the rest is compared bit by bit. In
    told, if given, pairs are counted: of the groups, left by the pivots, left by the bits."""
    first = table[:, 0].astype(np.int64)
    end = np.searchsorted(group, group, side="right")
    if told is not None:
        told["pairs"] = told.get("pairs", 0) + int((end - np.arange(len(group)) - 1).sum())
    at, lag = np.arange(len(group)), 1
    while len(at):
        at = at[at + lag < end[at]]
        at = at[first[at + lag] - first[at] <= most[at]]
        for part in np.array_split(at, -(-len(at) // 100_000)) if len(at) else ():
            i, j = part, part + lag
            bound = limit(i, j)
            for k in range(0, table.shape[1], 8):
                near = np.abs(table[i, k : k + 8] - table[j, k : k + 8]).max(axis=1) <= bound
                i, j, bound = i[near], j[near], bound[near]
            close = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64) <= bound
            if told is not None:
                told["pivots"] = told.get("pivots", 0) + len(i)
                told["bits"] = told.get("bits", 0) + int(close.sum())
            if close.any():
                yield i[close], j[close]
        lag += 1


class Forest:
    """Edges that connect what links, without cycles."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = self.root(x), self.root(y)
            if a != b:
                self.parent[b] = a
                self.edges.append((x, y))


def in_cells(rows: DataFrame, counts: DataFrame, key: str, by: str, largest: int) -> DataFrame:
    """rows with a cell (long) for each: groups of equal key and cell hold at most about 2 x largest rows.

    A key with over largest rows (counts has key and n) is cut into chunks by a hash of column by, and each pair of
    chunks is a cell of its own, so that every pair of the key meets and no task holds more than two chunks."""
    chunks = F.ceil(F.col("n") / largest).alias("_chunks")
    hot = common.saved(counts.where(F.col("n") > largest).select(key, chunks))
    if hot.isEmpty():
        return rows.withColumn("cell", F.lit(0).cast("long"))
    n, chunk = F.col("_chunks"), F.pmod(F.xxhash64(by), F.col("_chunks"))
    # chunk c meets chunk d in the cell of (least, greatest)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda d: F.least(chunk, d) * n + F.greatest(chunk, d))
    cells = F.when(n.isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells)
    # few keys are hot: at most rows / largest, of 16 bytes each; adaptive execution picks the join and splits its skew
    return rows.join(hot, key, "left").select(*rows.columns, F.explode(cells).alias("cell"))


def by_group(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.Table]:
    """Batches sorted by key and cell, cut and joined so that a group is never in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "cell"))
        cut = int(np.flatnonzero((key == key[-1]) & (cell == cell[-1]))[0])
        if held and cut == 0:
            last = held[-1].num_rows - 1
            same = held[-1].column("key")[last].as_py() == key[0] and held[-1].column("cell")[last].as_py() == cell[0]
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
    del held
    common.trim()


def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def groups_of(key: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Numbers from 0 of rows of equal key and cell, which stand side by side."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    return np.cumsum(new) - 1


# --- fingerprints of 64 bits ----------------------------------------------------------------------------------------


def masks(distance: int) -> list[np.uint64]:
    """Fingerprints that differ in at most distance bits agree on 2 of distance + 2 blocks: a mask for each two."""
    edges = [round(i * 64 / (distance + 2)) for i in range(distance + 3)]
    block = [sum(1 << b for b in range(edges[a], edges[a + 1])) for a in range(distance + 2)]
    return [np.uint64(a | b) for a, b in combinations(block, 2)]


def keyed(nodes: DataFrame, distance: int) -> DataFrame:
    """For each fingerprint fp (long) a row for each mask: key (salted by the mask's number), fp."""
    chosen = masks(distance)
    salt = np.arange(1, len(chosen) + 1, dtype=np.uint64) * MIX

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for t, mask in enumerate(chosen):
                key = ((fp & mask) ^ salt[t]) * MIX
                key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def links(nodes: DataFrame, distance: int = 3, pivots: int = 64, largest: int = 4000) -> DataFrame:
    """Edges a, b between fingerprints (column fp, distinct) that span, for each key, what links under it."""
    refs = references(pivots, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches):
            key, cell, fp = columns(rows, "key", "cell", "fp")
            group = groups_of(key, cell)
            several = np.bincount(group)[group] > 1
            group, fp = group[several], fp[several]
            fps = fp.view(np.uint64)[:, None]
            order = np.lexsort((np.bitwise_count(fps[:, 0] ^ refs[0, 0]), group))
            group, fps = group[order], fps[order]
            found, most = Forest(len(group)), np.full(len(group), distance)
            for i, j in survivors(group, fps, pivot_table(fps, refs), most, lambda i, j: most[i]):
                found.add(i, j)
            ends = np.array(found.edges, dtype=np.int64).reshape(-1, 2)
            node = fps[:, 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[ends[:, 0]]), pa.array(node[ends[:, 1]])], ["a", "b"])

    rows = keyed(nodes, distance)
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    rows = in_cells(rows, counts, "key", "fp", largest).select("key", "cell", "fp")
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "a long, b long")


def near_components(df: DataFrame, distance: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links, itself included) for every row.

    Texts with one fingerprint (exact copies among them) are one node, so a group of them never makes pairs. Null and
    empty texts have the fingerprint zero and link like others; a text may be as long as memory holds. Rows with a null
    doc_id take part; a component of such rows alone has a null component_id. Repeated rows are rows of their own, and
    ties don't arise. Other columns of df aren't read, whatever their names. An empty table gives no rows."""
    docs = common.saved(fingerprints(df, 3, doc_id, text))
    nodes = common.saved(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = graph.components(links(nodes, distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return docs.join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components, by near_components: see there for nulls, empty and long
    texts, ties, repeated rows, empty tables and other columns."""
    found = near_components(common.documents(spark, sf_dir))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", hexed, "component_id")
