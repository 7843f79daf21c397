"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BINS, BITS, WORDS = 128, 8, 5
LOW = (1 << 56) - 1


def probe_table(attempts: int, seed: int = 8) -> list[list[int]]:
    """For each bin, the bins that an empty one asks in turn: independent of the document, and random between bins."""
    return [random.Random(f"{seed} {b} {attempts}").sample(range(BINS), BINS)[:attempts] for b in range(BINS)]


def constant(value: list, kind: str) -> Column:
    """A literal array; Spark folds it once, however many elements it has."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds name: 128 bytes (array<tinyint>), the low 8 bits of the least hash in each bin.

    Words are lower-cased and cut at ASCII white space; shingles are 5 words, each hashed by a chain of XXH64 (pairs,
    fours, five), so that no shingle is put together as a string. Fewer words make one shingle of all; null, empty and blank texts are the shingle of no words. A hash's top 7 bits are
    its bin. An empty bin copies the first filled bin of its own probe sequence: 16 tries, then all bins. Every bin
    gets a sentinel above any hash, so that sorting leaves one least value for each bin, in order."""
    out = df.columns
    blank = "[" + "".join(f"\\x{ord(c):02x}" for c in " " + common.SPACES) + "]+"
    w, p = F.col("_words"), F.col("_pairs")
    chain = lambda a, b: F.xxhash64(a, b)
    rest = lambda c, start: F.slice(c, F.lit(start), F.size(c))
    shingles = F.zip_with(p, rest(w, WORDS), lambda a, b: F.shiftrightunsigned(F.xxhash64(a, b), 1))
    hashes = F.when(F.size(w) >= WORDS, F.slice(shingles, F.lit(1), F.greatest(F.lit(0), F.size(w) - (WORDS - 1)))).otherwise(
        F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(w, " ")), 1))
    )
    sentinels = F.array(*(F.lit((b << 56) | LOW) for b in range(BINS)))  # literals without nulls: longs are sorted unboxed
    h, least = F.col("_sorted"), F.col("_least")
    firsts = F.filter(h, lambda x, i: (i == 0) | (x.bitwiseXOR(F.get(h, i - 1)) > F.lit(LOW)))
    full = lambda x: x.bitwiseAND(F.lit(LOW)) != F.lit(LOW)

    def borrowed(i: Column, attempts: int) -> Column:
        table = constant(probe_table(attempts), "array<array<int>>")
        return F.aggregate(
            F.get(table, i),
            F.lit(None).cast("long"),
            lambda got,
            p: F.coalesce(got, F.when(full(F.get(least, p)), F.get(least, p))),
        )

    bits = F.transform(
        least,
        lambda x,
        i: (F.when(full(x), x).otherwise(F.coalesce(borrowed(i, 16), borrowed(i, BINS))).bitwiseAND(F.lit((1 << BITS) - 1)) - 128).cast("tinyint"),
    )
    return (
        df.select(*out, F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), blank), "").alias("_words"))
        .select(*out, w, F.zip_with(w, rest(w, 2), chain).alias("_pairs"))
        .select(*out, w, F.zip_with(p, rest(p, 3), chain).alias("_pairs"))  # of four words
        .select(*out, F.sort_array(F.concat(hashes, sentinels)).alias("_sorted"))
        .select(*out, firsts.alias("_least"))
        .select(*out, bits.alias(name))
    )


def packed(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda x: F.lpad(F.lower(F.hex(x.cast("int") + 128)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins, less what equal low bits give by chance (2^-8), from 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / BINS
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def interval(key: Column, starts: list[Column], first: int = 0) -> Column:
    """How many of the ascending starts are <= key, as a balanced tree of comparisons."""
    if not starts:
        return F.lit(first)
    mid = len(starts) // 2
    return (
        F.when(key < starts[mid], interval(key, starts[:mid], first))
        .otherwise(interval(key, starts[mid + 1 :], first + mid + 1))
    )


def cells(keys: DataFrame, rows_per_cell: int, ranges: int = 256) -> DataFrame:
    """range, starts: the keys at which cells of about rows_per_cell rows start (at most ranges x ranges + ranges), in
    ranges that Spark samples. keys: key (struct whose order is the rows' order), saved.

    Keys are ordered within ranges, exactly; only the starts leave them."""
    n = keys.count()
    per = max(rows_per_cell, -(-n // (ranges * ranges)))
    parts = max(1, min(ranges, n // (4 * per)))
    ranged = common.saved(keys.repartitionByRange(parts, "key").select("key", F.spark_partition_id().alias("range")))
    place = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    starts = ranged.withColumn("i", place).where((F.col("i") - 1) % per == 0)
    return common.saved(starts.groupBy("range").agg(F.array_sort(F.collect_list("key")).alias("starts")))


def with_next(df: DataFrame, doc_id: str, carried: list[str], rows_per_cell: int = 512) -> DataFrame:
    """Adds next_<c> for each c of carried: its value in the next row by descending doc_id, after the last the first.

    Null ids come last. Rows with one doc_id (null ones too) are ordered by a hash of the first of carried, which is part of
    a row's key, so that neither clustered nor repeated nor null ids fill a cell; only rows with equal ids and texts stay
    in one. Rows meet their neighbours in cells of the key order, so one exchange moves the texts; the last row of a cell
    gets the first one of the next cell by a join of one row a cell."""
    d, columns = F.col(doc_id), df.columns
    key = F.struct(
        d.isNull().alias("none"),
        F.coalesce(F.bitwise_not(d), F.lit(0)).alias("down"),
        F.xxhash64(carried[0]).alias("tie"),
    )
    table = cells(common.saved(df.select(key.alias("key"))), rows_per_cell)
    firsts = [r["first"] for r in table.select("range", F.get("starts", F.lit(0)).alias("first")).orderBy("range").collect()]
    literal = lambda k: F.struct(*(F.lit(k[c]).alias(c) for c in ("none", "down", "tie")))
    table = table.orderBy("range").coalesce(1).select(F.monotonically_increasing_id().alias("_range"), "starts")
    keyed = (
        df
        .withColumn("_key", key)
        .withColumn("_range", interval(F.col("_key"), [literal(k) for k in firsts[1:]]).cast("long"))
    )
    inside = F.coalesce(F.size(F.filter("starts", lambda s: s <= F.col("_key"))), F.lit(0))
    # at most 65,792 keys are broadcast
    celled = keyed.join(F.broadcast(table), "_range").withColumn("_cell", F.coalesce("_range", F.lit(0)) * 100_000 + inside)
    celled = celled.select(*columns, "_key", "_cell")
    # the id is part of the order so that all uses need the same columns, and share the exchange
    order = Window.partitionBy("_cell").orderBy("_key", doc_id)
    nexts = {f"next_{c}": F.lead(c).over(order) for c in carried}
    placed = celled.withColumns({"_less": F.lag(F.lit(True)).over(order), "_more": F.lead(F.lit(True)).over(order), **nexts})
    # the first row by lag, not row_number: that would put a limit below the exchange, which all uses share
    heads = placed.where("_less is null").select(F.col("_cell").alias("_next"), *(F.col(c).alias(f"next_{c}") for c in carried))
    ends = placed.where("_more is null").drop(*(f"next_{c}" for c in carried))
    by_cell = Window.orderBy("_cell")  # a row a cell
    every = by_cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = (
        celled
        .select("_cell")
        .distinct()
        .select("_cell", F.coalesce(F.lead("_cell").over(by_cell), F.first("_cell").over(every)).alias("_next"))
    )
    tails = ends.join(follow, "_cell").join(heads, "_next")
    result = [*columns, *(f"next_{c}" for c in carried)]
    return placed.where("_more").select(result).unionByName(tails.select(result))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprints of their texts and edited texts, and likenesses.

    Null texts count as empty, and empty ones have the fingerprint of no words; texts of any length are read whole; null
    doc_ids come last, and for ties and repeated rows see with_next. Other columns aren't read, whatever their names.
    An empty table gives no rows; a single document is its own next one."""
    docs = common.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(docs, F.col("text"), "bits"), "doc_id", ["text", "bits"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("next_text", cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "bits", "next_bits", edited.alias("edited"))
    rows = with_fingerprint(rows, F.col("edited"), "edited_bits")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bits")).alias("fingerprint"),
        packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )
