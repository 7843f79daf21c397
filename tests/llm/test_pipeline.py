"""Each stage on its own input, held against what the operator says of it and against brute force."""

import random
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from marlstone.llm import common, exact_dedup, toxicity


def test_stages(spark, folder):
    docs = common.documents(spark, folder).select(pipeline.COLUMNS)
    before = {r.doc_id: r for r in docs.collect()}
    scores = toxicity.score_documents(docs, toxicity.fit(spark, folder)).collect()
    clean = common.saved(pipeline.toxic(spark, docs, folder))
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in scores if r.score < 0.5)
    once = common.saved(pipeline.exact(spark, clean, folder))
    texts = [(r.text or "").translate(str.maketrans(common.UPPER, common.UPPER.lower())) for r in clean.collect()]
    kept = [(r.text or "").translate(str.maketrans(common.UPPER, common.UPPER.lower())) for r in once.collect()]
    assert sorted(kept) == sorted(set(texts))
    apart = common.saved(pipeline.near(spark, once, folder))
    words = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})((t or "").lower().split())
    left = {r.doc_id for r in apart.collect()}
    for r in once.collect():
        if r.doc_id not in left:
            likest = max(len(words(r.text) & words(o.text)) / len(words(r.text) | words(o.text)) for o in once.collect() if o.doc_id != r.doc_id)
            assert likest >= 0.7
    safe = common.saved(pipeline.secrets(spark, apart, folder))
    assert {r.doc_id for r in safe.collect()} == left
    for r in safe.collect():
        assert "0a1b2c3d4e5f60718293a4b5c6d7e8f9" not in (r.text or "")
        if r.text is not None and "[SECRET]" not in r.text and r.doc_id is not None:
            assert r.text == before[r.doc_id].text and r.n_chars == len(r.text)
    packed = pipeline.pack(spark, safe, folder)
    assert {r.doc_id for r in packed.collect()} == left
    assert exact_dedup.exact_groups(safe.select("doc_id", "text")).count() == safe.count()


def test_run(spark, folder, empty):
    assert pipeline.run(spark, folder).count() > 0
    assert pipeline.run(spark, empty).count() == 0


def test_near_copies_go(spark):
    base = " ".join(f"w{i * i % 977}x{i}" for i in range(300))
    rows = [(1, base), (2, base.replace("w49x7 ", "other ")), (3, " ".join(f"v{i * 7}" for i in range(300)))]
    docs = spark.createDataFrame(
        [(d, t, "en", "s", len(t)) for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    assert {r.doc_id for r in pipeline.near(spark, docs, "").collect()} == {1, 3}


def test_near_copies_are_those_of_brute_force(spark):
    """Pairs at 0.8 exactly and just below it, groups and common lines: components are those of all pairs."""
    r = random.Random(3)
    words = lambda n: [f"{r.randrange(10**6)}" for _ in range(n)]
    line, texts = words(25), []
    for i in range(150):
        base = words(r.choice([9, 24, 60, 61, 120, 300])) + (line if i % 2 else [])
        texts += [base, base + words(r.randrange(1, len(base) // 2)), base[: -r.randrange(1, len(base) // 3)]]
        at = r.randrange(len(base))
        texts.append(base[:at] + words(1) + base[at + 1 :])
    # 80 shingles of 100 are in both, 79 of 100, and one line over and over, which counts once
    exact = words(104)
    texts += [exact[:84], exact, (other := words(104))[:83], other, line * 40, line * 40 + words(30)]
    texts += [base[:i] + words(1) + base[i + 1 :] for base in [words(80)] for i in range(0, 80, 2) for _ in range(4)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    at, sharing = list(range(len(sets))), defaultdict(list)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in sharing[x]).items():
            if 9 * n >= 4 * (len(s) + len(sets[j])):
                a, b = sorted((root(i), root(j)))
                at[b] = a
        for x in s:
            sharing[x].append(i)
    docs = spark.createDataFrame(
        [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    want = {root(i) for i in range(len(sets))}
    assert len(want) > 250
    assert {r.doc_id for r in pipeline.near(spark, docs, "").collect()} == want


def test_near_copies_go_by_row(spark):
    """Copies that share a doc_id or have none leave one row, and another text under a dropped doc_id stays."""
    text = lambda c, last="": " ".join(f"{c}{i}" for i in range(60)) + last
    rows = [(
        1,
        text("a"),
    ), (2, text("a", " x")), (2, text("b")), (3, text("c")), (3, text("c", " x")), (None, text("d")), (None, text("d", " x"))]
    docs = spark.createDataFrame(
        [(d, t, "en", "s", len(t)) for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    got = pipeline.near(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in got) == [("1", "a"), ("2", "b"), ("3", "c"), ("None", "d")]


def test_near_copies_of_the_sample(spark):
    """All pairs of sf0.01 after exact dedup, by an index of shingles: the same rows stay."""
    docs = common.saved(pipeline.exact(spark, common.documents(spark, "/root/testdata/sf0.01"), ""))
    lower = str.maketrans(common.UPPER, common.UPPER.lower())
    rows = sorted((r.doc_id, (r.text or "").translate(lower).split()) for r in docs.collect())
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for _, t in rows]
    at, sharing = list(range(len(sets))), defaultdict(list)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    pairs = 0
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in sharing[x]).items():
            if 9 * n >= 4 * (len(s) + len(sets[j])):
                pairs += 1
                a, b = sorted((root(i), root(j)))
                at[b] = a
        for x in s:
            sharing[x].append(i)
    assert pairs
    assert {r.doc_id for r in pipeline.near(spark, docs, "").collect()} == {rows[i][0] for i in range(len(rows)) if root(i) == i}


def test_stages_may_be_called_before_the_first_is_written(spark):
    docs = [
        spark.createDataFrame([(i, f"{n} some words of text {i // 2} and more", "en", "s", 9) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
        for n in "ab"
    ]
    a, b = (pipeline.near(spark, d, "") for d in docs)
    assert (a.count(), b.count()) == (2, 2)
    c, d = pipeline.secrets(spark, a, ""), pipeline.pack(spark, b, "")
    assert (c.count(), d.count(), a.count()) == (2, 2, 2)


def test_packed_by_own_numbers_and_by_cells(spark):
    """Numbers from tasks or from cells, counts broadcast or joined: every piece once, sequences without gaps or excess."""
    from marlstone.llm import common, packing

    rows = [(i % 40 if i % 9 else None, i // 40, 0, 4096 if i % 7 == 0 else i % 13 * 100 + 1, bytes([i % 251])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids binary").repartition(5)
    pieces = common.saved(packing.numbered(df, rows_per_cell=50))
    assert pieces.select("length", "part", "own").distinct().count() == 600
    for broadcast in (10**6, 0):
        got = packing.packed(pieces, broadcast=broadcast).collect()
        assert sorted(map(str, (r[:5] for r in got))) == sorted(map(str, rows))
        ends = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 4096 and len(ends) <= 1.05 * sum(r[3] for r in rows) / 4096 + 1
    assert packing.packed(common.saved(packing.numbered(df.limit(0)))).count() == 0
