"""Vector codes against plain loops in Python's whole numbers, and against SQL."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
from conftest import make_vectors
from oracle import SF, same

from marlstone.llm import codes, queries


def test_oracle(spark):
    same(queries.QUERIES["op13_vector_codes"](spark, SF), queries.SQL["op13_vector_codes"])


def test_search_is_that_of_all_entries():
    """Ties, equal sums, equal entries, few entries, wide numbers: always the entry that a look at all would give."""
    r = np.random.default_rng(1)
    for n, k, width, spread in ((200, 256, 2, 3), (200, 40, 16, 300), (50, 1, 4, 5), (100, 7, 1, 2), (60, 30, 4, codes.LARGEST), (0, 5, 3, 4)):
        part, entries = (r.integers(-spread, spread + 1, (m, width)) for m in (n, k))
        away = ((part[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
        index, best = codes.equal_average_search(part, entries)
        assert index.tolist() == [min(range(k), key=lambda e: (row[e], e)) for row in away]
        assert best.tolist() == [min(row) for row in away]


def brute_force(rows):
    ok = lambda v: v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, np.array(v, dtype=np.float32), label) for i, v, label, *_ in rows if ok(v)]
    whole = [[max(-codes.LARGEST, min(codes.LARGEST, math.floor(float(x) * 1024))) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1].tolist()))
    books = [[whole[i][2 * p : 2 * p + 2] for i in order[:256]] for p in range(4)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))
    for _ in range(4):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for v in whole:
                members[nearest(v[2 * p : 2 * p + 2], book)[1]].append(v[2 * p : 2 * p + 2])
            for n, own in members.items():
                book[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [[nearest(v[2 * p : 2 * p + 2], books[p]) for p in range(4)] for v in whole]
    errors, by_label = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{n:02x}" for _, n in f), e, by_label[label], sha) for (i, _, label), f, e in zip(kept, found, errors))


def test_query(spark, folder):
    got = queries.QUERIES["op13_vector_codes"](spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(map(tuple, got.collect())) == brute_force(make_vectors())


def test_codes_stand_for_vectors(spark):
    """Decoded vectors are as far from the integers as the error says; other columns stay, clashing ones are replaced."""
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], "kept", "clash") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, other string, Code string")
    books = codes.train_codebooks(df, parts=3, entries=16)
    found = codes.encoded(df, books)
    assert [b.shape for b in books] == [(16, 2)] * 3 and sorted(c.lower() for c in found.columns) == ["code", "embedding", "error", "other", "vec_id"]
    for x in found.withColumn("back", codes.decoded(found["code"], books)).collect():
        whole = [math.floor(v * 1024) for v in x.embedding]
        assert x.error == sum((a - round(b * 1024)) ** 2 for a, b in zip(whole, x.back)) and x.other == "kept"


def test_fewer_rows_than_entries_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(2, [0.5, 1.0, 0.0, 0.25]), (1, [0.5, 1.0, 0.0, 0.25])], schema)
    books = codes.train_codebooks(few)
    assert all(len(b) == 2 for b in books) and [r.code for r in codes.encoded(few, books).collect()] == [[0] * 4] * 2
    for rows in ([], [(1, None)], [(1, [])]):
        df = spark.createDataFrame(rows, schema)
        assert codes.encoded(df, codes.train_codebooks(df)).count() == len([v for _, v in rows if v is not None])
