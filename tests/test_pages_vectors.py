"""Body text of pages, vectors of texts, and the similarity join of vectors."""

import random
import re

import numpy as np
import pytest
from oracle import SF, same
from pyspark.sql import functions as F

from marlstone.functions import pages
from marlstone.operators import latent, similarity


def blocks_of(spark, *html):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    return [r.blocks for r in df.select("page_id", pages.page_blocks(F.col("html")).alias("blocks")).orderBy("page_id").collect()]


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_planted_body_is_kept_and_navigation_goes(spark):
    """Of the words in articles nearly all stay, of those around them nearly none."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("html", pages.page_blocks(F.col("html")).alias("blocks")).collect()
    inside = stayed = outside = left = 0
    for html, blocks in rows:
        start, end = html.find("<article>"), html.find("</article>")
        parts = [html[:start], html[start:end], html[end:]]
        n = [sum(b.words for b in some) for some in blocks_of_parts(blocks, parts)]
        kept = [sum(b.words for b in some if b.kept) for some in blocks_of_parts(blocks, parts)]
        inside, stayed, outside, left = inside + n[1], stayed + kept[1], outside + n[0] + n[2], left + kept[0] + kept[2]
    assert inside > 10 * outside > 0
    assert stayed >= 0.95 * inside and left <= 0.05 * outside, (stayed / inside, left / outside)


def blocks_of_parts(blocks, parts):
    """Blocks by the part of the page that they are in, by the number of words before them."""
    ends = np.cumsum([words_in(p) for p in parts])
    out, seen = [[], [], []], 0
    for b in blocks:
        out[int(np.searchsorted(ends, seen, side="right"))].append(b)
        seen += b.words
    return out


def words_in(html):
    html = re.sub(r"(?is)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", html)
    html = re.sub(r"</?(?:p|li|ul|nav|div|article|h1|body|html|head|footer|br)\b[^>]*>", " ", html)
    return len(re.sub(r"<[^>]*>", "", html).split())


def test_blocks_of_odd_pages(spark):
    comment, quoted, entities, cut, none, empty = blocks_of(
        spark,
        f"<p>{LONG}</p><!-- <p>hidden</p> --><script>var a = '<!--<p>';</script><p>{LONG}</p>",
        f"<p title=\"a > b\" data-x='<p>'>{LONG} <b>bo</b>ld</p>",
        f"<p>{LONG} &amp;lt; &#65;&#x42; &eacute; &nosuch; &#0; & &amp</p>",
        f"<p>{LONG}</p><!-- never ends <p>{LONG}</p>",
        None,
        "",
    )
    assert [(b.words, b.kept) for b in comment] == [(13, True)] * 2
    assert quoted[0].text == f"{LONG} bold" and len(quoted) == 1
    assert entities[0].text == f"{LONG} &lt; AB é &nosuch; &#0; & &amp"
    assert len(cut) == 1 and none is None and empty == []


def test_links_short_blocks_and_headings(spark):
    link = "<li><a href='/x'>some link</a></li>"
    (found,) = blocks_of(spark, f"<ul>{link * 3}</ul><div>short ad</div><h2>Title</h2><p>{LONG}</p><p>short</p><p>{LONG}</p><div>at the end</div>")
    assert [b.text for b in found if b.kept] == ["Title", LONG, "short", LONG]
    assert [b.links for b in found[:3]] == [2, 2, 2]


def test_long_tags_and_many_marks(spark):
    """No pattern needs a stack or more time than in proportion to the page."""
    n = 100_000
    odd = ["<p " + "a='1' " * n + ">x", "<" * n, "<p '" * n, "&" * n, "<!--" * n, "<a>" * n, "<h1>" * n, "</" + "x" * n + ">", "&#" * n, "<script>" * n, "<p class=" * n, "<p " + "class='" * n + ">", "<p " + '"' * (2 * n + 1)]
    df = spark.createDataFrame([(h,) for h in odd], "html string").repartition(4)
    assert df.select(F.size(pages.page_blocks(F.col("html"))).alias("n")).agg(F.count("n")).first()[0] == len(odd)


def test_blocks_equal_sql(spark, tmp_path):
    made = random.Random(3)
    bits = [LONG, "few words", "<p>", "</p>", "<a href='>'>", "</a>", "<h1>", "</h1>", "<!--", "-->", "<br/>", "&amp;", "&#233;", "&#xZ;", "<b>", "\n", "<LI class=\"a\">", "<footer>", "<div class='x ad'>", "<script>", "</script >", "<", ">", "'", '"', "\x01\x02"]
    rows = [(i, "".join(made.choice(bits) for _ in range(made.randrange(40)))) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "odd"))
    got = df.select("page_id", F.posexplode(pages.page_blocks(F.col("html"))).alias("pos", "b")).select("page_id", "b.*")
    same(got, f"SELECT page_id, text, words, links, heading, kept FROM ({pages.blocks_sql(f"'{tmp_path}/odd/*.parquet'")})")


def test_latent_space_equals_the_whole_matrix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150").repartition(3)
    space = latent.fitted(docs, rank=12, width=256, rounds=30)
    assert np.abs(space.basis.T @ space.basis - np.eye(12)).max() < 1e-9
    table = docs.orderBy("doc_id").select(latent.features(F.col("text"), 256).alias("f")).toArrow().column(0).combine_chunks()
    x = np.concatenate(list(latent.weighted(table, space.idf)))
    values = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(space.values, values[:12], rtol=1e-4)
    # what the basis leaves out is what the other singular values hold
    left = np.linalg.norm(x - x @ space.basis @ space.basis.T) ** 2
    assert left == pytest.approx((values[12:] ** 2).sum(), rel=1e-4)


def test_near_copies_are_neighbours(spark):
    made = random.Random(5)
    words = ["".join(made.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    texts = [" ".join(made.choice(words) for _ in range(120)) for _ in range(60)]
    copies = [" ".join("other" if i % 40 == 7 else w for i, w in enumerate(t.split())) for t in texts]
    rows = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(copies)), (500, None), (501, ""), (502, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    space = latent.fitted(df, rank=32, width=1024)
    got = {r.doc_id: r.embedding for r in latent.embedded(df, space).collect()}
    assert len(got) == len(rows) and got[500] is None and got[501] is None and got[502] == got[0]
    x, y = (np.array([got[k + i] for i in range(60)]) for k in (0, 100))
    assert ((x @ y.T).argmax(axis=1) == np.arange(60)).all()
    again = latent.fitted(df.repartition(2), rank=32, width=1024)
    assert np.allclose(space.basis, again.basis, atol=1e-6)
    nothing = df.where("doc_id < 0")
    assert latent.embedded(nothing, latent.fitted(nothing, rank=4, width=64)).count() == 0


def planted(n, width, made):
    """Vectors in noisy groups, one of which holds a third of all."""
    centres = made.standard_normal((n // 8, width))
    which = np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % len(centres))
    return centres[which] + 0.3 * made.standard_normal((n, width))


@pytest.mark.parametrize("block", [2000, 20])
def test_similarity_join_recall(spark, block):
    """At least 0.9 of all pairs and no wrong ones, with buckets in blocks too; equal vectors are linked through one."""
    x = planted(400, 24, np.random.default_rng(1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, x[5].tolist()), (1001, None), (1002, [0.0] * 24), (None, x[6].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.where(np.triu(unit @ unit.T, 1) >= 0.85))}
    assert len(want) > 1000
    representatives, members = similarity.distinct_directions(df)
    found = [(r.a, r.b) for r in similarity.similar_pairs(representatives, 0.85, block=block).collect()]
    assert len(found) == len(set(found)) and set(found) <= want
    assert len(found) >= 0.9 * len(want), (len(found), len(want))
    assert {r.vec_id for r in members.collect()} == {*range(400), 1000}
    linked = {r.vec_id: r for r in similarity.similarity_join(df, 0.85, block=block).collect()}
    assert linked[1000].representative == 5 and linked[1000].links == linked[5].links
    near = [j for p in found for i, j in (p, p[::-1]) if i == 5]
    assert linked[5].links == 1 + len(near)
    assert similarity.similarity_join(df.where("vec_id < 0"), 0.85).count() == 0


def test_linked_pairs_by_codes_are_the_similar_pairs(spark):
    """Links need no whole vectors but close to the threshold, and copies of codes are of few bytes."""
    x = planted(150, 24, np.random.default_rng(3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    codes = similarity.coded(df)
    assert {len(r.code) for r in codes.collect()} == {48}
    assert [f.name for f in similarity.in_buckets(codes, 1.0, 9, 8, range(3, 5), True).schema] == ["table", "key", "vec_id", "code"]
    pairs = {(r.a, r.b) for r in similarity.similar_pairs(df, 0.85, bits=4).collect()}
    assert pairs and pairs == {(r.a, r.b) for r in similarity.linked_pairs(df, 0.85, bits=4).collect()}


def test_links_are_those_of_all_pairs(spark):
    """Every link counts, also at the threshold itself, of copies and negative ids; what leaves a task doesn't grow with links."""
    made = np.random.default_rng(4)
    a = made.standard_normal((300, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    across = made.standard_normal((300, 16))
    across -= (across * a).sum(axis=1, keepdims=True) * a
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    cos = 0.9 + np.repeat([-1e-9, 1e-9, 3e-7], 100)[:, None]
    group = np.ones(16) + 1e-3 * made.standard_normal((200, 16))  # all of them similar
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * across, group])
    ids = [*range(-400, 400), *range(1000, 1040)]  # the last are copies
    x = np.concatenate([x, x[:40]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.9).sum(axis=1) - 1).tolist()
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    for block in (120_000, 350):
        got = {r.vec_id: r.links for r in similarity.similarity_join(df, 0.9, block=block).collect()}
        assert [got[i] for i in ids] == want
    sizes = df.select(F.col("vec_id").alias("representative"), F.lit(1).alias("n"))
    found = similarity.link_counts(similarity.unit_rows(df, sizes), 0.9, 350).collect()
    assert sum(want) > 40_000 and sum(r.b is None for r in found) <= 3 * len(ids) and any(r.b is not None for r in found)


def test_links_of_rows_with_one_id_and_great_weights():
    """Rows of one name are no pair, wherever they are; weights beyond what four bytes add up exactly are added exactly."""
    names = np.array([5, 7, 5, 5, 9] * 300)
    n = np.where(names == 9, (1 << 24) + 1, 1)
    rows = np.tile(np.array([[0.6, 0.8]], dtype=np.float32), (len(names), 1))
    far: dict[int, int] = {}
    for a, b, sums in similarity.counted((names, n, rows), None, 0.9, tile=64):
        assert b is None
        for k, v in zip(a.tolist(), sums.tolist()):
            far[k] = far.get(k, 0) + v
    assert far == {k: sum(int(w) for m, w in zip(names, n) if m != k) * int((names == k).sum()) for k in (5, 7, 9)}


def test_vectors_on_counted_features_are_those_of_texts(spark):
    """Texts are cut into tokens once, for the fit and for the vectors; null, empty, CJK and repeated texts too."""
    made = random.Random(8)
    texts = [" ".join(made.choice("abcdefgh") * 3 for _ in range(made.randrange(1, 600))) for _ in range(300)]
    rows = [*enumerate(texts), (300, None), (301, ""), (302, "你好，世界。"), (302, "aaa " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = latent.counted(df, 256)
    assert counts.columns == ["doc_id", "found", "times"] and counts.count() == len(rows)
    space, on = latent.fitted(df, rank=8, width=256), latent.fitted_on(counts, rank=8, width=256)
    assert np.array_equal(space.idf, on.idf) and np.allclose(space.values, on.values)
    key = lambda r: (r.doc_id, r.embedding is None, r.embedding)
    want, got = (sorted(x.select("doc_id", "embedding").collect(), key=key) for x in (latent.embedded(df, space), latent.embedded_on(counts, space)))
    assert len(got) == len(rows) and sum(r.embedding is None for r in got) == 2
    for a, b in zip(want, got):
        assert a.doc_id == b.doc_id and (a.embedding is None) == (b.embedding is None)
        assert a.embedding is None or np.allclose(a.embedding, b.embedding, atol=1e-12)
    nothing = latent.counted(df.where("doc_id < 0"), 64)
    assert latent.embedded_on(nothing, latent.fitted_on(nothing, rank=4, width=64)).count() == 0


def test_passes_have_no_more_tasks_than_cores_ask_for(spark, monkeypatch):
    seen = []
    whole = latent.times_gram
    monkeypatch.setattr(latent, "times_gram", lambda found, *rest: (seen.append(found.rdd.getNumPartitions()), whole(found, *rest))[1])
    df = spark.createDataFrame([(i, f"some words of {i}") for i in range(60)], "doc_id long, text string").repartition(40)
    latent.fitted_on(latent.counted(df, 64), rank=4, width=64, rounds=1)
    assert len(seen) == 2 and max(seen) <= 2 * spark.sparkContext.defaultParallelism
