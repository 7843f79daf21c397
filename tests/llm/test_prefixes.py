"""The prefix trie against a plain one, and against SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import make_turns
from oracle import SF, same
from pyspark.sql import functions as F

from marlstone.llm import prefixes, queries

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))


def trie_of(conversations):
    """Of {conv_id: [(role, text)]}: what the query returns of each node."""
    members, kids, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = Counter(), Counter()
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(own) - 1) * words(node[-1][1]) if node else 0
    return Counter(
        (min(own), len(n), min(members[n[:-1]]) if n else None, len(own), len(kids[n]) if n in kids else 0, leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n])))))
        for n, own in members.items()
    )


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    return {c: own.get(base(c), [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def test_oracle(spark):
    same(queries.QUERIES["op11_prefix_trie"](spark, SF), queries.SQL["op11_prefix_trie"])


def test_query(spark, folder):
    got = queries.QUERIES["op11_prefix_trie"](spark, folder)
    want = rebuilt(make_turns())
    assert any(not turns for turns in want.values())
    assert Counter(map(tuple, got.select(COLUMNS).collect())) == trie_of(want)


@pytest.mark.parametrize("block", [1, 3, 4, 50])
def test_block_lengths(spark, block):
    """Conversations that part inside blocks, at their edges, or end there; the same trie whatever the block."""
    r = random.Random(block)
    common = [("user", f"turn {i}") for i in range(17)]
    convs = {i: common[: r.choice([0, 1, 3, 4, 5, 8, 9, 16, 17])] + [("user", r.choice("abc")) for _ in range(r.randrange(6))] for i in range(60)}
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns, 1)]
    turns = prefixes.digested(spark.createDataFrame(rows, "conv_id long, pos long, role string, text string"))
    found = prefixes.prefix_trie(turns, spark.createDataFrame([(c,) for c in convs], "conv_id long"), block)
    assert Counter(map(tuple, found.select(COLUMNS).collect())) == trie_of(convs)
    said = {(r.conv_id, r.pos): (r.role, r.text) for r in spark.createDataFrame(rows, "conv_id long, pos long, role string, text string").collect()}
    shown = prefixes.with_last_turn(found, spark.createDataFrame(rows, "conv_id long, pos long, role string, text string")).collect()
    assert len(shown) == found.count() and all((x.role, x.text) == said.get((x.conv_id, x.depth), (None, None)) for x in shown)


def test_order_through_cells(spark):
    """Places are those of one sort, however turns fall into cells."""
    r = random.Random(3)
    rows = [(r.randrange(3), r.choice([None, r.randrange(-50, 900)]), r.choice(["a", None]), str(r.randrange(5))) for _ in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((x.conv_id, x.pos, x.role, x.text) for x in prefixes.ordered(df, cell=16).collect())
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text))
    assert got == sorted((c, i, *x[2:]) for c, turns in own.items() for i, x in enumerate(sorted(turns), 1))


def test_ends_read_in_parts(spark):
    """A node with more conversations than an Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        ends = spark.range(100).select(F.when(F.col("id") < 90, F.lit("a")).otherwise(F.lit("b")).alias("node"), F.col("id").alias("conv_id"))
        got = {r.node: r.ends_sha256 for r in prefixes.digests_of_ends(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"a": sha(",".join(map(str, range(90)))), "b": sha(",".join(map(str, range(90, 100))))}
