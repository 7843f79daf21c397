"""Exact dedup with a heavy-hitter split: frequent digests are settled map-side, the rest by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(common.ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def marked(rows: DataFrame, support: float) -> DataFrame:
    """Adds top (struct id, rid) and n to rows (text_sha256, id, rid and others; a saved table): the row that stays of
    each group, and the group's size.

    Misra-Gries counters (freqItems: 1 / support counters a task, merged) name every digest with more than a share
    support of the rows. One pass counts these candidates exactly; at most 1 / support verified winners are broadcast
    and answer for their rows without a shuffle. Other groups are aggregated before the shuffle, and the answers joined
    to their rows, a join that adaptive execution splits where one group is large."""
    top = F.max(F.struct("id", "rid")).alias("top")
    key = rows.select("text_sha256", "id", "rid")
    candidates = rows.select(F.col("text_sha256").alias("d")).freqItems(["d"], support)
    candidates = candidates.select(F.explode("d_freqItems").alias("text_sha256"))
    winners = key.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(top, F.count("*").alias("n"))
    winners = common.saved(winners.where("n > 1"))
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = light.groupBy("text_sha256").agg(top, F.count("*").alias("n"))
    return heavy.unionByName(light.join(groups, "text_sha256"))


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = 1e-3) -> DataFrame:
    """The columns of df but its text, and keep_id, group_size, kept and text_sha256 (columns of df with these names are
    replaced) for every row.

    Null texts are equal to empty ones; texts of any length are hashed whole. One row of a group is kept: the one with
    the largest doc_id; null ids come last, and among rows with one id (repeated rows) the one read last. keep_id is
    null if all ids are null. An empty table gives no rows."""
    added = {"keep_id", "group_size", "kept", "text_sha256", text.lower()}
    names = [c for c in df.columns if c.lower() not in added]
    held = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in names)).alias("held")
    rows = df.select(
        held,
        digest(F.col(text)).alias("text_sha256"),
        F.col(doc_id).alias("id"),
        F.monotonically_increasing_id().alias("rid"),
    )
    found = marked(common.saved(rows), support)
    kept = (F.col("rid") == F.col("top.rid")).alias("kept")
    return found.select(
        *(F.col(f"held.`{c}`").alias(c) for c in names),
        F.col("top.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        kept,
        "text_sha256",
    )


def without_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = 1e-3) -> DataFrame:
    """The rows of df that exact_groups keeps, with all their columns. Of rows that share text and doc_id any one stays.

    df is read again for its texts, and no copy of it is made. Rows whose digest has no copy, by a list of 64-bit hashes
    that is broadcast if it is small by its size, stay where they are; only the others meet their group's answer."""
    sha, theirs, top, times = (common.unused(df, c) for c in ("_sha", "_theirs", "_top", "_times"))
    known, id_ = df.withColumn(sha, digest(F.col(f"`{text}`"))), F.col(f"`{doc_id}`")
    keys = common.saved(known.select(F.col(sha).alias("text_sha256"), id_.alias("id"), F.monotonically_increasing_id().alias("rid")))
    several = marked(keys, support).where("n > 1").groupBy(F.col("text_sha256").alias(theirs))
    several = common.saved(several.agg(F.max("top.id").alias(top), F.count_if(F.col("id").eqNullSafe(F.col("top.id"))).alias(times)))
    mark = F.xxhash64(sha) == F.col(theirs)
    marks = common.saved(several.select(F.xxhash64(theirs).alias(theirs)).distinct())
    found = known.join(marks, mark, "left_semi").join(several, F.col(sha) == F.col(theirs), "left")
    stay = found.where(F.col(times).isNull() | id_.eqNullSafe(F.col(top)))
    out = known.join(marks, mark, "left_anti").drop(sha).unionByName(stay.where(F.coalesce(times, F.lit(1)) == 1).select(*df.columns))
    if not several.where(F.col(times) > 1).isEmpty():
        out = out.unionByName(stay.where(F.col(times) > 1).dropDuplicates([sha]).select(*df.columns))
    return out


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their group, by exact_groups: see there for nulls, empty and long texts, ties, repeated rows,
    empty tables and other columns."""
    found = exact_groups(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
