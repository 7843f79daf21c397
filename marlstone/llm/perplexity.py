"""Quality rules: counts of a text, and the perplexity of its characters under a modified Kneser-Ney model.

The model is counted by Spark over all documents, a model for each language, of runs of up to five characters. Characters
are of 128 kinds, so a run is a whole number and the number of different runs doesn't grow with the corpus for ever.
Runs and contexts stand in arrays sorted by hash. A document whose perplexity is outside its language's band is rejected."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ORDER, BITS, KINDS = 5, 7, 128
MIX = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 8


# --- counts of one text ---------------------------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of 8 words that the text has twice or more.

    Windows are told apart by ranks of pairs, of pairs of pairs, and so on: exact, whatever the words."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    size = 1
    while size < WINDOW:
        pair = rank[: len(rank) - size] * (int(rank.max()) + 1) + rank[size:]
        _, rank = np.unique(pair, return_inverse=True)
        size *= 2
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str) -> tuple[int, ...]:
    """The BASE counts. Words are runs of anything but space and U+0009 to U+000D, which is what bytes.split() has."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


# --- runs of characters ---------------------------------------------------------------------------------------------


def _kinds() -> np.ndarray:
    """The kind of each of the first 256 characters: white space, a to z, digits, U+00DF to U+00FF, ASCII marks, others."""
    kind = 93 + np.arange(256) % 35
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[97:123] = 1 + np.arange(26)
    kind[48:58] = 27
    kind[0xDF:0x100] = 28 + np.arange(33)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    kind[marks] = 61 + np.arange(len(marks))
    return kind


TABLE = _kinds()


def kinds_of(text: str) -> np.ndarray:
    """The kinds of a text's characters in lower case, runs of white space as one."""
    point = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.where(point < 256, TABLE[np.minimum(point, 255)], 93 + point % 35).astype(np.int64)
    return kind[np.append(True, (kind[1:] > 0) | (kind[:-1] > 0))] if len(kind) else kind


def runs_of(kind: np.ndarray) -> np.ndarray:
    """The number of the run of ORDER characters that ends at each character but the first ones."""
    n = len(kind) - ORDER + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    return reduce(lambda run, k: run << BITS | kind[k : k + n], range(1, ORDER), kind[:n])


def counted(df: DataFrame) -> DataFrame:
    """lang, run, n: how often each run of ORDER characters occurs in each language (columns text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 1000):
            lang = np.array(part.column(1).to_pylist(), dtype=object)
            runs = [runs_of(kinds_of(t)) for t in part.column(0).to_pylist()]
            for name in sorted(set(lang)):
                found, n = np.unique(np.concatenate([runs[i] for i in np.flatnonzero(lang == name)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "run", "n"])

    rows = df.select("text", "lang").mapInArrow(run, "lang string, run long, n long")
    return rows.groupBy("lang", "run").agg(F.sum("n").alias("n"))


# --- the model ------------------------------------------------------------------------------------------------------


def discounts(grams: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: what modified Kneser-Ney takes off counts of 1, 2, and 3 or more, from counts of counts.

    Where these are too few to say, 0.5; always within 0.05 of the least and the most that can be taken."""
    ones = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]
    found = grams.groupBy("lang").agg(*ones)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def taken(k: int) -> Column:
        off = F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
        return F.least(F.greatest(F.coalesce(off, F.lit(0.5)), F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}")

    return found.where("n1 + n2 > 0").select("lang", *(taken(k) for k in (1, 2, 3))).unionByName(
        found.where("n1 + n2 = 0").select("lang", *(F.lit(0.5).alias(f"d{k}") for k in (1, 2, 3)))
    )


def kneser_ney(runs: DataFrame) -> DataFrame:
    """The model's entries from the counted runs of ORDER characters: lang, order, code, context (whether the entry is one),
    shard, a, b. For a run: a is its discounted count. For a context: a is the count of all that follows it, and b the
    weight of the next lower order.

    Below the highest order a run counts once for each different character before it. The characters a run of an order
    is judged by share the last one of its context, and shard is that: entries of other shards are never asked for."""
    out, grams = [], runs.select("lang", F.col("run").alias("code"), "n")
    for order in range(ORDER, 0, -1):
        grams = common.saved(grams)
        known = grams.join(F.broadcast(discounts(grams)), "lang")  # a row for each language
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        before = F.shiftright("code", BITS)
        rest = F.sum(off) / F.sum("n")
        contexts = known.groupBy("lang", before.alias("code")).agg(F.sum("n").cast("double").alias("a"), rest.alias("b"))
        of = lambda code, context: [
            F.lit(order).alias("order"), "code", F.lit(context).alias("context"), (code.bitwiseAND(KINDS - 1) if order > 1 else F.lit(-1)).cast("int").alias("shard")
        ]
        out.append(known.withColumns({"a": F.col("n") - off, "b": F.lit(0.0)}).select("lang", *of(before, False), "a", "b"))
        out.append(contexts.select("lang", *of(F.col("code"), True), "a", "b"))
        lower = F.col("code").bitwiseAND((1 << BITS * (order - 1)) - 1)
        grams = grams.groupBy("lang", lower.alias("code")).agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, out)


def hashed(lang: np.ndarray, order: int | np.ndarray, code: np.ndarray, context: bool | np.ndarray) -> np.ndarray:
    """lang: 64-bit hashes of languages. The product of a code is its own for each, so only languages could collide."""
    mark = np.asarray(order, dtype=np.uint64) << np.uint64(40) | np.asarray(context, dtype=np.uint64) << np.uint64(44)
    return (code.view(np.uint64) | mark) * MIX ^ lang.view(np.uint64)


class Model:
    """Entries in arrays sorted by hash."""

    def __init__(self, lang: np.ndarray, order: np.ndarray, code: np.ndarray, context: np.ndarray, a: np.ndarray, b: np.ndarray):
        key = hashed(lang, order, code, context)
        at = np.argsort(key)
        self.key, self.a, self.b = key[at], a[at], b[at]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key

    def probability(self, lang: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Of each run's last character after those before it, from the lowest order up."""
        p = np.full(len(run), 1 / KINDS)
        for order in range(1, ORDER + 1):
            code = run & ((1 << BITS * order) - 1)
            at, known = self.find(hashed(lang, order, code >> BITS, True))
            mine, seen = self.find(hashed(lang, order, code, False))
            over = np.where(seen, self.a[mine], 0.0) / np.where(known, self.a[at], 1.0)
            p = np.where(known, over + self.b[at] * p, p)
        return p


def shards_of(entries: DataFrame, most: int) -> list[list[int]]:
    """Sets of shards with at most `most` entries each, or of one shard."""
    sizes = {r["shard"]: r["n"] for r in entries.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    out, room = [], 0
    for shard in sorted(s for s in sizes if s >= 0):
        if not out or sizes[shard] > room:
            out.append([])
            room = most
        out[-1].append(shard)
        room -= sizes[shard]
    return out or [[]]


def bits_of(df: DataFrame, entries: DataFrame, most: int = 3_000_000, with_text: bool = False) -> DataFrame:
    """df (text and lang without nulls, others) with the BASE counts and bits: the mean of -log2 of its characters'
    probabilities; null for texts of under five characters, white space counted once. text goes unless with_text.

    The entries of one set of shards at a time (`most` of them, 24 bytes each) are broadcast; with more sets than one the
    sums so far are written with the documents, as often as there are sets. No characters are left out."""
    spark = df.sparkSession
    df = df.drop("_sum", "_places", "bits", *BASE)
    names, at, language = df.columns, df.columns.index("text"), df.columns.index("lang")
    rows = df.withColumns({"_sum": F.lit(0.0), "_places": F.lit(0).cast("long"), "_lang": F.xxhash64("lang")})
    sets = shards_of(entries, most)
    for turn, shards in enumerate(sets):
        last = turn == len(sets) - 1
        some = entries.where(F.col("shard").isin([-1, *shards]))
        t = some.select(F.xxhash64("lang").alias("lang"), "order", "code", "context", "a", "b").toArrow()
        told = spark.sparkContext.broadcast(Model(*(t.column(c).to_numpy() for c in ("lang", "order", "code", "context", "a", "b"))))
        mine = np.isin(np.arange(KINDS), shards)

        def run(batches: Iterator[pa.RecordBatch], told=told, mine=mine, last=last) -> Iterator[pa.RecordBatch]:
            for part in common.slices(batches, 1000):
                texts = part.column(at).to_pylist()
                runs = [r[mine[r >> BITS & (KINDS - 1)]] for r in (runs_of(kinds_of(t)) for t in texts)]
                sizes = np.array([len(r) for r in runs], dtype=np.int64)
                total, place = part.column(len(names)).to_numpy().copy(), part.column(len(names) + 1).to_numpy() + sizes
                lang = part.column(len(names) + 2).to_numpy()
                for own in np.unique(lang):
                    docs = np.flatnonzero((lang == own) & (sizes > 0))
                    if len(docs):
                        flat = np.concatenate([runs[i] for i in docs])
                        order = np.argsort(flat)
                        new = np.append(True, flat[order][1:] != flat[order][:-1])
                        distinct = flat[order][new]
                        log = -np.log2(told.value.probability(np.full(len(distinct), own), distinct))
                        each = np.empty(len(flat))
                        each[order] = log[np.cumsum(new) - 1]
                        total[docs] += np.add.reduceat(each, np.cumsum(sizes[docs]) - sizes[docs])
                if not last:
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(total), pa.array(place), part.column(len(names) + 2)], part.schema.names)
                    continue
                counts = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, len(BASE))
                bits = pa.array(total / np.maximum(place, 1), mask=place == 0)
                kept = [c for i, c in enumerate(part.columns[: len(names)]) if with_text or i != at]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c.copy()) for c in counts.T), bits], out)

        out = [c for c in names if with_text or c != "text"] + [*BASE, "bits"]
        if last:
            schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in out]
            return rows.mapInArrow(run, ", ".join([*schema, *(f"{c} long" for c in BASE), "bits double"]))
        before, rows = rows, common.saved(rows.mapInArrow(run, rows.schema))
        if turn:
            common.released(before)
    raise AssertionError("there is always a set")


def bands(scored: DataFrame, width: float) -> DataFrame:
    """lang, low, high: width times the usual distance (1.4826 times the median one, at least 0.05) from the median of bits,
    among texts of the language that have bits and don't fail the base rules.

    Medians are of a histogram of steps of 0.001, exact to that, which is all that is sorted."""
    rows = scored.where("bits is not null and not base_failed").select("lang", F.round(F.col("bits") * 1000).cast("long").alias("x"))

    def median(df: DataFrame) -> DataFrame:
        # written, so that all of a language's counts are added up before they meet in one task
        steps = common.saved(df.groupBy("lang", "x").agg(F.count("*").alias("n")))
        upto = F.sum("n").over(Window.partitionBy("lang").orderBy("x"))
        whole = F.sum("n").over(Window.partitionBy("lang"))
        return steps.select("lang", "x", (2 * upto >= whole).alias("past")).where("past").groupBy("lang").agg(F.min("x").alias("middle"))

    middle = median(rows)
    away = median(rows.join(middle, "lang").select("lang", F.abs(F.col("x") - F.col("middle")).alias("x")))
    usual = F.greatest(F.col("away") * 1.4826, F.lit(50.0)) * width
    both = middle.join(away.withColumnRenamed("middle", "away"), "lang")
    return both.select("lang", ((F.col("middle") - usual) / 1000).alias("low"), ((F.col("middle") + usual) / 1000).alias("high"))


def judged(df: DataFrame, width: float = 8.0, text: str = "text", lang: str = "lang", most: int = 3_000_000, with_text: bool = False) -> DataFrame:
    """df's columns (text only with_text) with the BASE counts, base_failed, bits, low, high and kept, for every row.

    base_failed: under 20 words, or over 30 % of the words in windows of eight that repeat. Other documents are rejected if
    their bits are outside the band of their language; perplexity is 2 to the power of bits. The model is counted over
    all rows. Null texts count as empty, and null languages are a language of their own; a text of any length is scored
    whole, in the memory of its task; repeated rows are rows of their own, and ties don't arise. Columns of df that are
    named like the new ones are replaced. An empty table gives no rows."""
    new = {*BASE, "base_failed", "bits", "low", "high", "kept", "_sum", "_places", "_lang", "text", "lang"}
    keep = [c for c in df.columns if c.lower() not in new | {text.lower(), lang.lower()}]
    held = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("held")
    empty = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = df.select(held, empty(text).alias("text"), empty(lang).alias("lang"), F.col(f"`{lang}`").isNull().alias("none"))
    entries = common.saved(kneser_ney(counted(rows)))
    scored = bits_of(rows, entries, most, with_text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = common.saved(scored.withColumn("base_failed", failed))
    banded = scored.join(F.broadcast(bands(scored, width)), "lang", "left")  # a row for each language
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True))
    return banded.select(
        *(F.col(f"held.`{c}`").alias(c) for c in keep), *([F.col("text").alias(text)] if with_text else []),
        F.when(~F.col("none"), F.col("lang")).alias(lang), *BASE, "base_failed", "bits", "low", "high", (~F.col("base_failed") & inside).alias("kept"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and verdicts, by judged(): see there for nulls, empty and long texts, ties, repeated
    rows, empty tables and other columns."""
    found = judged(common.documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", *BASE, "base_failed", "kept")
