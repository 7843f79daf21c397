"""Similar texts: sets of five-word shingles with a Jaccard similarity of 0.8 or more, and their components. Exact.

Candidates: in any one order of all shingles, two sets with a similarity of 0.8 share one of their first
size - ceil(0.8 size) + 1 shingles. The order is that of the hashes, with common shingles last. Texts that share such
a shingle are a group.

Within a group, pairs are discarded by their sizes, by pivot distance tables and bit by bit (simhash.survivors) on a
fingerprint of 1024 parities: each shingle that only one of two sets has flips one bit, so two sets differ in at least
as many shingles as bits, and those at 0.8 or more in at most a ninth of their sizes' sum. Majority fingerprints
(SimHash proper) have no such bound, and lost a fifth of the pairs. Survivors are compared as whole sets.

A group of n similar texts would make n * n survivors, so rounds compare each text with a few hubs of its group alone,
and the last, complete one leaves out pairs that those have connected already: components are the same."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, simhash

SHINGLE = 5
LONGS = 16
PIVOTS = 8


def shingles(text: str) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def first_ones(size: np.ndarray | int) -> np.ndarray | int:
    """How many shingles of a set are its prefix; none have none."""
    return (size - (4 * size + 4) // 5 + 1) * (size > 0)


def prefix(found: np.ndarray, common_ones: np.ndarray) -> np.ndarray:
    """The first shingles in the common order: by hash, those of common_ones (sorted) after all others."""
    n = first_ones(len(found))
    if not len(common_ones):
        return found[:n]
    last = common_ones[np.minimum(np.searchsorted(common_ones, found), len(common_ones) - 1)] == found
    return np.concatenate([found[~last], found[last]])[:n]


def parities(found: np.ndarray) -> np.ndarray:
    """A bit for each of 1024 parts of the hashes: whether the set has an odd number there."""
    n = 64 * LONGS
    odd = np.bincount((found % np.uint64(n)).astype(np.int64), minlength=n) % 2 == 1
    return np.packbits(odd, bitorder="little")


def lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, dtype=np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def prefixes(df: DataFrame, common_ones: np.ndarray) -> DataFrame:
    """row, digest (of the shingle set), size, prefix and parities of each row of df (columns row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            digests = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            bits = pa.array([parities(s).tobytes() for s in sets], pa.binary())
            out = [part.column(0), digests, sizes, lists([prefix(s, common_ones) for s in sets]), bits]
            yield pa.RecordBatch.from_arrays(out, ["row", "digest", "size", "prefix", "parities"])

    rows = df.select("row", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "row long, digest binary, size long, prefix array<long>, parities binary")


def sampled(df: DataFrame, docs: int = 10_000, least: int = 10) -> DataFrame:
    """Shingles (token, count) that at least `least` of about `docs` rows have: a guess that only saves time."""
    some = df.where(F.pmod(F.xxhash64("row"), F.lit(max(1, df.count() // docs))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            found = [shingles(t) for t in part.column(0).to_pylist()]
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat)], ["token"])

    tokens = some.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "token long")
    return tokens.groupBy("token").count().where(F.col("count") >= least)


def candidates(rows: DataFrame, hubs: int = 0, turn: int = 0) -> DataFrame:
    """Distinct pairs a < b of nodes with different roots whose fingerprints and prefixes allow a similarity of 0.8.

    rows: key, weight (of how many shingles the key is one), cell, node, size, root, parities. With hubs, only pairs with
    one of so many hubs of each group, its least nodes by a hash that differs from turn to turn.

    What two sets share behind their prefixes is at most what is left of the larger rest, so their prefixes must share
    what is missing. That discards pairs of long texts, whose fingerprints are full. It is counted over all keys, which
    with hubs sees their pairs alone; what that loses, the complete round finds."""
    refs = simhash.references(PIVOTS, LONGS)
    salt = np.uint64(random.Random(turn).getrandbits(64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in simhash.by_group(batches):
            key, cell, node, size, root, weight = simhash.columns(table, "key", "cell", "node", "size", "root", "weight")
            group = simhash.groups_of(key, cell)
            bits = np.frombuffer(b"".join(table.column("parities").to_pylist()), dtype=np.uint64).reshape(-1, LONGS)
            # sets of different sizes, or of one root, are never compared: leave out groups of one root
            least, largest = (f.reduceat(root, np.flatnonzero(np.diff(group, prepend=-1))) for f in (np.minimum, np.maximum))
            some = (least < largest)[group]
            group, node, size, root, bits, weight = (x[some] for x in (group, node, size, root, bits, weight))
            pairs = list((hub_pairs if hubs else all_pairs)(group, node, size, root, bits))
            a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*pairs) if pairs else ((), ())))
            rest = np.maximum(size[a] - first_ones(size[a]), size[b] - first_ones(size[b]))
            need = (4 * (size[a] + size[b]) + 8) // 9 - rest
            ends = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*ends, weight[a], need)], ["a", "b", "weight", "need"])

    def allowed(size: np.ndarray):
        def limit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            alike = (5 * size[i] >= 4 * size[j]) & (5 * size[j] >= 4 * size[i])
            return np.where(alike, (size[i] + size[j]) // 9, -1)

        return limit

    def hub_pairs(group, node, size, root, bits):
        order = np.lexsort((node.view(np.uint64) * simhash.MIX ^ salt, group))
        heads = np.flatnonzero(np.diff(group[order], prepend=-1))
        many = np.diff(np.append(heads, len(order)))
        place = np.arange(len(order)) - np.repeat(heads, many)
        for h in range(hubs):
            with_hub = np.flatnonzero(place > h)
            i, j = order[with_hub - place[with_hub] + h], order[with_hub]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            close = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= allowed(size)(i, j)
            yield i[close], j[close]

    def all_pairs(group, node, size, root, bits):
        order = np.lexsort((np.bitwise_count(bits ^ refs[0]).sum(axis=1), group))
        own_size, own_root, own_bits = size[order], root[order], bits[order]
        close = allowed(own_size)
        limit = lambda i, j: np.where(own_root[i] != own_root[j], close(i, j), -1)
        table = simhash.pivot_table(own_bits, refs)
        for i, j in simhash.survivors(group[order], own_bits, table, own_size // 4, limit):
            yield order[i], order[j]

    by_key = rows.repartition("key", "cell").sortWithinPartitions("key", "cell")
    found = by_key.mapInArrow(run, "a long, b long, weight long, need long")
    found = found.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.first("need").alias("need"))
    return common.saved(found.where("weight >= need").select("a", "b"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b: rows) whose texts' sets have a similarity of 0.8 or more; texts: row, text.

    The sets of the texts that are in some pair are made once. Which texts those are is written first, so that a list
    that is small by its size is broadcast, and the other texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            sets = lists([shingles(t) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), sets], ["row", "set"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    needed = texts.join(common.saved(needed), "row", "left_semi").select("row", F.coalesce("text", F.lit("")).alias("text"))
    sets = common.saved(needed.mapInArrow(run, "row long, set array<long>"))
    side = lambda x: sets.select(F.col("row").alias(x), F.col("set").alias(f"set_{x}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    alike = 9 * both >= 4 * (F.size("set_a") + F.size("set_b"))
    return common.saved(pairs.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b"))


def shared(nodes: DataFrame) -> DataFrame:
    """key (a prefix shingle of several nodes), n (how many), x and y (hashes of which): aggregated before the shuffle."""
    tokens = nodes.select("node", F.explode("prefix").alias("key"))
    which = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(c) for i, c in enumerate("xy")]
    return tokens.groupBy("key").agg(F.count("*").alias("n"), *which).where("n > 1")


def similar_components(
    df: DataFrame, frequent: int = 1000, most_frequent: int = 200_000, largest: int = 4000, hubs: int = 8, turns: int = 3
) -> DataFrame:
    """row and component (a row of it; one value for all rows connected by similarities of 0.8 or more), for every row.

    df: row (long, unique), text, in files, as it is read several times; other columns aren't read. Words are lower-cased
    in A-Z only. Null and empty texts have no shingles and are copies of each other, fewer than five words are one
    shingle. Repeated rows are copies. An empty table gives no rows.

    Shingles that are common in a sample or in over `frequent` prefixes (most_frequent of each at most) are put last in
    the order. Any set of them may be: it only saves pairs. Of shingles that the very same texts share, one is enough.
    Groups of over largest texts are dealt in cells. Rounds with hubs go on, turns of them at most, while the groups'
    pairs with different roots are many times their rows."""

    def last(counts: DataFrame) -> np.ndarray:
        top = counts.orderBy(F.desc("count"), "token").limit(most_frequent).select("token")
        return np.sort(np.array([r[0] for r in top.collect()], dtype=np.int64).view(np.uint64))

    first = last(sampled(df))
    sets = common.saved(prefixes(df, first))
    several = sets.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("n")).where("n > 1")
    copies = common.saved(sets.select("row", "digest").join(several, "digest").select("row", "node"))
    nodes = sets.join(copies.where("row <> node").select("row"), "row", "left_anti")
    nodes = nodes.select(F.col("row").alias("node"), "size", "prefix", "parities")
    keys = common.saved(shared(nodes))
    hot = last(keys.where(F.col("n") > frequent).select(F.col("key").alias("token"), F.col("n").alias("count")))
    hot = np.setdiff1d(hot, first)
    if len(hot):
        every = np.union1d(first, hot)
        # a prefix that ends before the common shingles and has no new one is the same in both orders; others change
        tokens = df.sparkSession.createDataFrame([(int(t),) for t in every.view(np.int64)], "token long")
        held = nodes.select("node", F.explode("prefix").alias("token")).join(F.broadcast(tokens), "token", "left_semi")
        again = common.saved(held.select(F.col("node").alias("row")).distinct())
        other = prefixes(df.select("row", "text").join(again, "row", "left_semi"), every)
        other = other.select(F.col("row").alias("node"), "size", "prefix", "parities")
        nodes = common.saved(nodes.join(again.withColumnRenamed("row", "node"), "node", "left_anti").unionByName(other))
        keys = common.saved(shared(nodes))
    chosen = keys.groupBy("x", "y", "n").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    chosen = common.saved(chosen.select("key", "n", "weight"))
    rows = nodes.select("node", F.explode("prefix").alias("key")).join(chosen.select("key", "weight"), "key")
    cells = simhash.in_cells(common.saved(rows.select("key", "weight", "node")), chosen, "key", "node", largest)
    facts = nodes.select("node", "size", "parities")

    def rooted(roots: DataFrame | None) -> DataFrame:
        known = facts.join(roots, "node", "left") if roots else facts.withColumn("root", F.lit(None).cast("long"))
        return known.withColumn("root", F.coalesce("root", "node"))

    def apart(roots: DataFrame) -> bool:
        """Whether the groups have more than 4 pairs with different roots for each row."""
        by_root = cells.join(rooted(roots).select("node", "root"), "node").groupBy("key", "cell", "root").agg(F.count("*").alias("n"))
        by_group = by_root.groupBy("key", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        rows, other = by_group.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        return (other or 0) > 4 * (rows or 0)

    edges = verified(candidates(cells.join(rooted(None), "node"), hubs), df)
    roots = common.saved(graph.components(edges))
    for turn in range(1, turns):
        if not apart(roots):
            break
        edges = edges.unionByName(verified(candidates(cells.join(rooted(roots), "node"), hubs, turn), df))
        roots = common.saved(graph.components(edges))
    more = verified(candidates(cells.join(rooted(roots), "node")), df)
    if not more.isEmpty():
        roots = common.saved(graph.components(edges.unionByName(more)))
    named = df.select("row").join(copies, "row", "left").select("row", F.coalesce("node", "row").alias("node"))
    return named.join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("component"))
