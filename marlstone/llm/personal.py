"""Personal data: certain kinds by pattern, and unseen identifiers by contexts that bootstrapping learns from them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed patterns of the base kinds; the order is the tie-break of equal starts. An email is a run of LOCAL, an @ and a
# DOMAIN. An ip starts at the first of its digits: a later one would fail as that did.
KINDS = ["email", "ip", "card", "phone", "context"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MARK = re.compile(r"[0-9@]")
WORD = re.compile(r"\S+")
EDGE = "\"'.,;:!?()[]{}<>|*#$%&"
SPAN = "struct<start:long,ord:int,end:long>"
HINT = "struct<start:long,end:long,patterns:array<string>,instance:long,seed:boolean>"
SHAPE = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "A" for c in common.UPPER}, **{c: "a" for c in common.UPPER.lower()}})


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping emails, found from each @ outwards: time in proportion to the text, whatever its runs."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds, sorted: each kind leftmost and non-overlapping, failures dropped."""
    out = [(start, 0, end) for start, end in emails(text)]
    for m in IP.finditer(text) if "." in text else ():
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Words:
    """The words of a text (cut at white space), whole, whatever their lengths."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = [], []
        for m in WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def patterns(self, start: int, end: int, most: int = 3) -> list[str]:
        """The lexical patterns at a place: one to three words before it, two or three after it, the last word before it
        with the place's word shape, and the words on both sides. What is left of a word that the place cuts counts."""
        at = bisect_right(self.starts, start) - 1
        left = [self.text[self.starts[i] : min(self.ends[i], start)] for i in range(max(0, at - most), at + 1)]
        at = bisect_left(self.ends, end)
        right = [self.text[max(self.starts[i], end) : self.ends[i]] for i in range(at, min(len(self.ends), at + most + 1))]
        left, right = ([w.lower() for w in x if w.strip(EDGE + "=-")] for x in (left, right))
        left, right = left[-most:], right[:most]
        out = ["<" + " ".join(left[-n:]) for n in range(1, len(left) + 1)]
        out += [">" + " ".join(right[:n]) for n in range(2, len(right) + 1)]
        if left:
            out.append("#" + left[-1] + " " + re.sub(r"(.)\1+", r"\1+", self.text[start:end].translate(SHAPE)))
        if left and right:
            out.append("=" + left[-1] + " _ " + right[0])
        return out


def hints(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[str], int, bool]]:
    """Patterns and instance of every seed (base span) and of every other word that looks like an identifier: at least
    6 characters, white space and EDGE apart, with 4 digits or an @."""
    if not MARK.search(text):
        return []
    words, out = Words(text), []
    instance = lambda value: xxhash.xxh64_intdigest(value) >> 1
    for start, _, end in base:
        out.append((start, end, words.patterns(start, end), instance(text[start:end]), True))
    free, ends = 0, [end for _, _, end in base]
    for a, b in zip(words.starts, words.ends):
        if b - a < 6:
            continue
        word = text[a:b]
        if not MARK.search(word):
            continue
        value = word.strip(EDGE)
        start = a + len(word) - len(word.lstrip(EDGE))
        end = start + len(value)
        if len(value) < 6 or not ("@" in value or sum(c in "0123456789" for c in value) >= 4):
            continue
        while free < len(base) and ends[free] <= start:
            free += 1
        if any(x[0] < end and x[2] > start for x in base[free : free + 4]):
            continue
        out.append((start, end, words.patterns(start, end), instance(value), False))
    return out


def extracted(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (a key), doc_id, base (array of spans) and hints of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("ord", pa.int32()), ("end", pa.int64())]))
        hint = [(
            "start",
            pa.int64(),
        ), ("end", pa.int64()), ("patterns", pa.list_(pa.string())), ("instance", pa.int64()), ("seed", pa.bool_())]
        for part in common.slices(batches):
            texts = part.column(2).to_pylist()
            base = [base_spans(t) for t in texts]
            found = [[dict(zip(("start", "end", "patterns", "instance", "seed"), x)) for x in hints(t, b)] for t, b in zip(texts, base)]
            named = [[dict(zip(("start", "ord", "end"), x)) for x in b] for b in base]
            out = [part.column(0), part.column(1), pa.array(named, spans), pa.array(found, pa.list_(pa.struct(hint)))]
            yield pa.RecordBatch.from_arrays(out, ["row", "doc_id", "base", "hints"])

    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), body)
    return rows.mapInArrow(run, f"row long, doc_id long, base array<{SPAN}>, hints array<{HINT}>")


def trusted(edges: DataFrame, confidence: float = 0.6, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The patterns of high confidence (pattern, score), and the unseen instances that they discover (instance).

    edges: pattern, instance, seed. Over the graph of patterns and instances, a pattern's score is the share of known
    instances among its instances and one more; it is trusted at that confidence with at least so many known ones. An
    unseen instance becomes known if its trusted patterns don't all fail it (1 - product of 1 - score) at that
    confidence, and then counts as a seed for others. Scores only rise, so rounds go on until nothing new is known."""
    edges = common.saved(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    known, n = common.saved(edges.where("seed").select("instance").distinct()), -1
    while True:
        count = known.count()
        marked = edges.join(known.withColumn("known", F.lit(1)), "instance", "left")
        scores = marked.groupBy("pattern").agg(F.sum("known").alias("k"), F.count("*").alias("n"))
        score = F.col("k") / (F.col("n") + 1)
        good = scores.where(F.col("k") >= least).select("pattern", score.alias("score")).where(F.col("score") >= confidence)
        if count == n:
            return good, known.join(edges.where("seed").select("instance").distinct(), "instance", "left_anti")
        n = count
        good = common.saved(good)
        doubt = F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))
        new = edges.where("not seed").join(good, "pattern").groupBy("instance").agg(doubt.alias("doubt"))
        new = new.where(1 - F.col("doubt") >= confidence).select("instance")
        known = common.saved(known.unionByName(new).distinct())


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    said = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(said, ",")


def personal_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans for every row: an array, sorted, of start, ord (a place in KINDS) and end; the base kinds, and
    context for what bootstrapping finds. Code points, end exclusive.

    A discovered identifier is reported wherever a trusted pattern stands beside it. Null texts count as empty; texts of
    any length are read whole; repeated rows are rows of their own, and count once in the graph, which has distinct
    patterns and instances. Spans that start together are told apart by kind. Other columns of df aren't read, whatever
    their names. An empty table gives no rows."""
    found = common.saved(extracted(df, doc_id, text))
    seen = found.select("row", F.explode("hints").alias("h")).select("row", "h.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "seed")
    good, new = trusted(edges)
    places = seen.where("not seed").join(new, "instance").withColumn("pattern", F.explode("patterns"))
    places = places.join(good.select("pattern"), "pattern", "left_semi").select("row", "start", "end").distinct()
    span = F.struct("start", F.lit(KINDS.index("context")).alias("ord"), "end")
    more = places.groupBy("row").agg(F.collect_list(span).alias("more"))
    none = F.array().cast(f"array<{SPAN}>")
    spans = F.array_sort(F.concat("base", F.coalesce("more", none)))
    return found.select("row", "doc_id", "base").join(more, "row", "left").select("doc_id", spans.alias("spans"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data, by personal_spans: see there for nulls, empty and long texts, ties, repeated
    rows, empty tables and other columns."""
    found = personal_spans(common.documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["ord"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["ord"] < KINDS.index("context"))
    sha = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, KINDS[:-1]), sha, joined(F.col("spans")).alias("spans"))
