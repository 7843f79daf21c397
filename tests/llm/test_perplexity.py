"""Quality rules against plain loops, and the model against its definition."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import common, perplexity as P, queries


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def plain_model(rows):
    """Probabilities of the last character of a run, by modified Kneser-Ney, from dictionaries."""
    raw = Counter((r["lang"] or "", tuple(k)) for r in rows for kind in [P.kinds_of(r["text"] or "").tolist()] for k in zip(*(kind[i:] for i in range(P.ORDER))))
    grams = {P.ORDER: raw}
    for m in range(P.ORDER - 1, 0, -1):
        grams[m] = Counter((lang, g[1:]) for lang, g in grams[m + 1])
    off, after = {}, defaultdict(list)
    for m, own in grams.items():
        for lang in {lang for lang, _ in own}:
            n = [sum(c == i for (at, _), c in own.items() if at == lang) for i in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
            off[m, lang] = [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[1] + n[2] else 0.5, 0.05), k - 0.05) if k < 4 and (n[k] or k) else 0 for k in (1, 2, 3)]
        for (lang, g), c in own.items():
            after[m, lang, g[:-1]].append(c)

    def probability(lang, run):
        p = 1 / P.KINDS
        for m in range(1, P.ORDER + 1):
            g = tuple(run[-m:])
            counts = after.get((m, lang, g[:-1]))
            if counts:
                d = lambda c: off[m, lang][min(c, 3) - 1]
                c = grams[m].get((lang, g), 0)
                p = ((c - d(c) if c else 0) + sum(map(d, counts)) * p) / sum(counts)
        return p

    return probability


def test_query(spark, folder, rows):
    got = queries.QUERIES["op12_quality_rules"](spark, folder).collect()
    want = Counter((d, *base(t)) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


@pytest.mark.parametrize("most", [10**6, 40])
def test_perplexity_is_that_of_the_definition(spark, folder, most):
    """Every document's bits, with all entries at once and with sets of them one after the other; bands from medians."""
    docs = common.documents(spark, folder).where("length(text) < 5000")
    plain = plain_model(docs.collect())
    found = P.judged(docs, most=most, with_text=True).collect()
    assert len(found) == docs.count() and any(r.lang is None for r in found)
    for r in found:
        kind = P.kinds_of(r.text).tolist()
        runs = list(zip(*(kind[i:] for i in range(P.ORDER))))
        want = -sum(math.log2(plain(r.lang or "", run)) for run in runs) / len(runs) if runs else None
        assert r.bits == (None if want is None else pytest.approx(want, rel=1e-9))
    for lang in {r.lang for r in found}:
        own = [r for r in found if r.lang == lang]
        x = sorted(round(r.bits * 1000) for r in own if r.bits is not None and not r.base_failed)
        if x:
            middle = x[(len(x) + 1) // 2 - 1]
            away = sorted(abs(v - middle) for v in x)[(len(x) + 1) // 2 - 1]
            usual = max(1.4826 * away, 50) * 8
            assert all((r.low, r.high) == (pytest.approx((middle - usual) / 1000), pytest.approx((middle + usual) / 1000)) for r in own)
        assert all(r.kept == (not r.base_failed and (r.bits is None or r.low <= r.bits <= r.high)) for r in own)


def test_probabilities_add_up_to_one(spark, folder):
    entries = P.kneser_ney(P.counted(common.documents(spark, folder).select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))))
    t = entries.select(F.xxhash64("lang").alias("lang"), "order", "code", "context", "a", "b").toArrow()
    model = P.Model(*(t.column(c).to_numpy() for c in ("lang", "order", "code", "context", "a", "b")))
    lang = t.column("lang").to_numpy()[0]
    r = random.Random(8)
    for before in [P.kinds_of("the "), P.kinds_of("ed o"), np.array([r.randrange(128) for _ in range(4)])]:
        runs = np.array([P.runs_of(np.append(before, k))[0] for k in range(P.KINDS)])
        assert model.probability(np.full(len(runs), lang), runs).sum() == pytest.approx(1)


def test_gibberish_goes_and_prose_stays(spark):
    """Both edges of a band: letters at random, and one syllable in longer and longer words."""
    r = random.Random(2)
    some = ["".join(r.choice(["tha", "ne", "ri", "so", "lo"]) for _ in range(r.randrange(1, 4))) for _ in range(200)]
    prose = [(i, " ".join(r.choice(some) for _ in range(120)), "en") for i in range(300)]
    odd = [(1000, " ".join("".join(chr(r.randrange(97, 123)) for _ in range(7)) for _ in range(80)), "en")]
    odd += [(1001, " ".join("so" * (i + 1) for i in range(60)), "en")]
    found = {x.doc_id: x for x in P.judged(spark.createDataFrame(prose + odd, "doc_id long, text string, lang string")).collect()}
    assert all(found[d].kept for d, _, _ in prose)
    assert found[1000].bits > found[1000].high and not found[1000].kept
    assert found[1001].bits < found[1001].low and not found[1001].kept


def test_kinds():
    assert P.TABLE.max() < P.KINDS and len(set(P.TABLE[97:123])) == 26 and P.kinds_of("A  \n b").tolist() == [1, 0, 2]
    assert P.kinds_of("日é").max() < P.KINDS and P.runs_of(P.kinds_of("abcd")).tolist() == []
