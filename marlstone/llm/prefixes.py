"""Conversation prefix trie: what conversations share from their first turn on, by digests of fixed-length blocks of turns.

Conversations are first grouped by block: those with the same first blocks are one node, however many they are. Turn
boundaries are looked at inside blocks only, and counted anew only where siblings diverge, over distinct blocks and not
over conversations. Sums over subtrees double their reach each round, so a depth of d takes log2(d) rounds.

Places and digests within a conversation come from running totals of cells of rows, so no task holds a whole one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 4
ROOT = "0-0"
WORDS = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: A total: the aggregate, what brings two of its values together, and the column.
Total = tuple[Callable[[Column], Column], Callable[[Column, Column], Column], Column]
XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def running(rows: DataFrame, key: str, cell: str, order: list[str], totals: dict[str, Total]) -> DataFrame:
    """Adds running totals (named, the row itself included) over the rows of a key by order; cell must be an ascending
    function of the first column of order, without nulls.

    Totals run over cells first and then inside them: what a window has to itself is a cell, or a row for each cell."""
    sums = rows.groupBy(key, cell).agg(*(f(c).alias(n) for n, (f, _, c) in totals.items()))
    earlier = Window.partitionBy(key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(key, cell, *(F.coalesce(f(n).over(earlier), F.lit(0)).alias(f"_{n}") for n, (f, _, _) in totals.items()))
    inner = Window.partitionBy(key, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumns({n: f(c).over(inner) for n, (f, _, c) in totals.items()}).join(before, [key, cell])
    return both.withColumns({n: merge(F.col(f"_{n}"), F.col(n)) for n, (_, merge, _) in totals.items()}).drop(cell, *(f"_{n}" for n in totals))


def ordered(conversations: DataFrame, cell: int = 256) -> DataFrame:
    """conv_id, pos (from 1), role, text of every turn: by turn (null first), equal turns by role and text.

    Null roles and texts become empty. Turns with a null conv_id belong to no conversation and are left out; repeated
    rows are turns of their own. cell: how far turn numbers in one cell may lie apart."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", empty("role"), empty("text"))
    rows = rows.withColumn("cell", F.coalesce(F.floor(F.col("turn") / cell).cast("long"), F.lit(-(2**62))))
    placed = running(rows, "conv_id", "cell", ["turn", "role", "text"], {"pos": (F.sum, lambda a, b: a + b, F.lit(1).cast("long"))})
    return placed.select("conv_id", "pos", "role", "text")


def digested(turns: DataFrame) -> DataFrame:
    """conv_id, pos, t (a digest of role and text), w (the text's words): all that the trie reads of a turn."""
    t = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return turns.select("conv_id", "pos", t.alias("t"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("w"))


def mixed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from digested turns, and their conv_ids (turnless ones too): conversation c has the first h
    turns of c - c % 20 and then its own behind its first h, where h = crc32(c) % 4."""
    ids = turns.select("conv_id").distinct()
    base, h = F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    heads = turns.where("pos <= 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "pos", "t", "w")
    taken = ids.select("conv_id", base.alias("base"), h.alias("h")).join(heads, "base").where("pos <= h")
    have = heads.groupBy("base").agg(F.max("pos").alias("have"))
    own = turns.select("*", base.alias("base"), h.alias("h")).where("pos > h").join(have, "base", "left")
    shift = F.least("h", F.coalesce("have", F.lit(0))) - F.col("h")
    own = own.select("conv_id", (F.col("pos") + shift).alias("pos"), "t", "w")
    return taken.select("conv_id", "pos", "t", "w").unionByName(own), ids


def in_blocks(turns: DataFrame, block: int) -> DataFrame:
    """conv_id, k, turns (structs t, w), own and prev: digests of all blocks up to this one, and up to the one before."""
    blocks = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / block).alias("k")).agg(F.array_sort(F.collect_list(F.struct("pos", "t", "w"))).alias("turns"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda x: x["t"]), ""), 256)
    blocks = blocks.select("conv_id", "k", F.floor(F.col("k") / 64).alias("cell"), F.transform("turns", lambda x: F.struct(x["t"].alias("t"), x["w"].alias("w"))).alias("turns"), digest.alias("digest"))
    # two lanes of 64 bits; a block counts with its place, so the xor of all tells sequences apart
    lanes = {f"x{i}": F.xxhash64(F.lit(i), "k", "digest") for i in range(2)}
    found = running(blocks.withColumns(lanes), "conv_id", "cell", ["k"], {f"p{i}": (*XOR, F.col(f"x{i}")) for i in range(2)})
    name = lambda a, b: F.concat(F.hex(a), F.lit("-"), F.hex(b))
    prev = name(*(F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")) for i in range(2)))
    return found.select("conv_id", "k", "turns", name(F.col("p0"), F.col("p1")).alias("own"), prev.alias("prev"))


def node_of(n: Column, block: int) -> Column:
    """The node behind the first n turns of a block (columns prev, turns, own): at its full length the block's own."""
    inside = F.sha2(F.concat("prev", F.array_join(F.transform(F.slice("turns", 1, n), lambda x: x["t"]), "")), 256)
    return F.when(n == block, F.col("own")).when(n == 0, F.col("prev")).otherwise(inside)


def nodes_of(blocks: DataFrame, block: int) -> DataFrame:
    """node, parent, depth, n (conversations), conv_id (the least), w (words of the last turn) of all nodes but the root."""
    distinct = blocks.groupBy("prev", "own").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("k").alias("k"), F.first("turns").alias("turns"))
    distinct = common.saved(distinct)
    alone = distinct.groupBy("prev").agg(F.count("*").alias("s"), F.min("own").alias("own")).where("s = 1").select("own", F.lit(True).alias("alone"))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: F.struct(i.alias("i"), node_of(i, block).alias("node"), node_of(i - 1, block).alias("parent"), F.get("turns", i - 1)["w"].alias("w")),
    )
    listed = distinct.join(alone, "own", "left").select("k", "n", "conv_id", "alone", F.explode(steps).alias("s"))
    listed = listed.select("s.node", "s.parent", (F.col("k") * block + F.col("s.i")).alias("depth"), "n", "conv_id", "s.w", "alone")
    diverging = listed.where("alone is null").groupBy("node", "parent", "depth")
    diverging = diverging.agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.min("w").alias("w"))
    return listed.where("alone").drop("alone").unionByName(diverging)


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of each node (columns node, conv_id): its conv_ids, ascending, comma-joined, are read in order
    and hashed as they come, so that a node with very many is never held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            names, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            heads = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
            done = []
            for a, b in zip(heads, [*heads[1:], len(names)]):
                said = ",".join(map(str, ids[a:b].tolist())).encode()
                if names[a] == node:
                    sha.update(b"," + said)
                    continue
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = names[a], hashlib.sha256(said)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (node, sha.hexdigest())], ["node", "ends_sha256"])

    in_order = ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    return in_order.mapInArrow(run, "node string, ends_sha256 string")


def subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """node, leaves, saved: sums of these columns over the node and all below it (nodes has parent and depth too).

    In a round each node's sums reach the ancestor twice as far up; only nodes that have one take part."""
    at = nodes.select("node", F.col("parent").alias("up"), "depth", "leaves", "saved")
    step = 1
    while step <= deepest:
        deep = at.where(F.col("depth") >= step)
        more = deep.groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        further = deep.where(F.col("depth") >= 2 * step).select("node", "up").join(at.select(F.col("node").alias("up"), F.col("up").alias("_up")), "up")
        grown = at.drop("up").join(more, "node", "left").join(further.select("node", F.col("_up").alias("up")), "node", "left")
        plus = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        before, at = at, common.saved(grown.select("node", "up", "depth", plus("leaves"), plus("saved")))
        if step > 1:
            common.released(before)
        step *= 2
    return at.select("node", "leaves", "saved")


def prefix_trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each distinct sequence of first turns, the empty one (the root) included: node and parent (keys), conv_id
    (the least of its conversations), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos (from 1, gapless), t and w, as digested() gives them; ids: conv_id, each once, of turnless
    conversations too. n_leaves counts nodes without children in the node's subtree, itself included, and saved_tokens
    adds up (n_convs - 1) * w there: the words that needn't be processed again. No conversations give no rows."""
    total, least = ids.agg(F.count("*"), F.min("conv_id")).first()
    blocks = common.saved(in_blocks(turns, block))
    root = ids.sparkSession.createDataFrame([(ROOT, None, 0, total, least, 0)] if total else [], "node string, parent string, depth long, n long, conv_id long, w long")
    nodes = common.saved(nodes_of(blocks, block).unionByName(root))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct(node_of(F.size("turns"), block).alias("node")), "k")["node"].alias("node"))
    ends = ids.join(last, "conv_id", "left").select(F.coalesce("node", F.lit(ROOT)).alias("node"), "conv_id")
    known = nodes.join(children, "node", "left").join(digests_of_ends(ends), "node", "left")
    known = known.withColumns({"children": F.coalesce("children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY_SHA))})
    known = common.saved(known.withColumns({"leaves": (F.col("children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("w")}))
    deepest = known.agg(F.max("depth")).first()[0] or 0
    own = known.drop("leaves", "saved").join(subtree_sums(known, deepest), "node")
    # the root's children, which may be very many, need no join
    parents = known.where("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    lower = own.where("depth > 1").join(parents, "parent")
    upper = own.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long")))
    return upper.unionByName(lower.select(*upper.columns)).select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def with_last_turn(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes with role and text of each node's last turn (null at the root), from turns with conv_id, pos, role, text."""
    last = turns.select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.drop("role", "text").join(last, ["conv_id", "depth"], "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations as mixed() rebuilds them: see there, in ordered() and in prefix_trie() for nulls,
    empty and long texts, ties, repeated rows, empty tables and other columns."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns, ids = mixed(common.saved(digested(ordered(conversations))))
    return prefix_trie(turns, ids).drop("node", "parent")


OP11_SQL = r"""WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce(list_prepend(4294967295, range(8 * length(s))), lambda crc, i: (CASE WHEN (xor(crc, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1])::BIGINT ELSE 0 END)) & 1 = 1
    THEN xor(xor(crc, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1])::BIGINT ELSE 0 END) >> 1, 3988292384) ELSE xor(crc, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1])::BIGINT ELSE 0 END) >> 1 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM own)),
heads AS (SELECT ids.c, o.pos, o.role, o.text FROM ids JOIN own o ON o.c = ids.c - ids.c % 20 AND o.pos <= ids.h),
tails AS (SELECT o.c, o.pos - ids.h + coalesce(n, 0) AS pos, o.role, o.text FROM own o JOIN ids ON o.c = ids.c AND o.pos > ids.h LEFT JOIN (SELECT c, count(*) AS n FROM heads GROUP BY c) t ON t.c = ids.c),
turns AS (FROM heads UNION ALL FROM tails),
mem AS (SELECT c, 0 AS d, '' AS key, 0 AS w FROM ids UNION ALL
  SELECT c, pos, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY pos), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM turns),
lasts AS (SELECT c, max(d) AS d FROM mem GROUP BY c),
nodes AS (SELECT key, mem.d AS d, min(mem.c) AS c, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(CASE WHEN lasts.d = mem.d THEN mem.c::VARCHAR END, ',' ORDER BY mem.c), '')) AS ends
  FROM mem JOIN lasts USING (c) GROUP BY key, mem.d),
up AS (SELECT n.key, n.d, p.key AS parent FROM nodes n JOIN mem p ON p.c = n.c AND p.d = n.d - 1),
kids AS (SELECT parent, count(*) AS k FROM up GROUP BY parent),
below AS (SELECT a.key, sum((k IS NULL)::BIGINT) AS leaves, sum((n.n - 1) * n.w) AS saved FROM nodes n LEFT JOIN kids ON kids.parent = n.key JOIN mem a ON a.c = n.c AND a.d <= n.d GROUP BY a.key)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n LEFT JOIN up USING (key) LEFT JOIN nodes p ON p.key = up.parent LEFT JOIN kids ON kids.parent = n.key JOIN below ON below.key = n.key"""
