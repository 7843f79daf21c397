"""A corpus pipeline over documents: five stages, each on all that the one before kept.

All stages take nulls in any column, and read and return the columns of documents; more columns, whatever their names,
are left out. An empty table gives an empty table.

A stage keeps the tables that its result reads until sources.shared.clean(), so stages may be called in any order and
their results written later; run() alone gives them back, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common, exact_dedup, packing, secrets_scan, similar, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model, trained on the labels of sf_dir, scores 0.5 or more.

    Null and empty texts are scored like others; repeated rows go or stay together. From here on the session's Arrow
    batches have at most 1000 rows, and row groups that it writes common.GROUP_BYTES, as the JVM and the workers hold them
    beside what other stages have left there."""
    spark.conf.set(common.BATCH, min(int(spark.conf.get(common.BATCH)), 1000))
    spark.conf.set(common.GROUP, min(int(spark.conf.get(common.GROUP, str(common.GROUP_BYTES))), common.GROUP_BYTES))
    scored = toxicity.score_documents(docs.select(COLUMNS), toxicity.fit(spark, sf_dir))
    return scored.where("score < 0.5").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) one row of the largest doc_id stays, whatever its other columns.

    Null texts are equal to empty ones; null doc_ids come last; among rows of one doc_id any one stays."""
    return exact_dedup.without_copies(docs.select(COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by similarities of 0.8 and more (sets of five-word shingles), one row of the least doc_id stays.

    Null doc_ids come last. Rows count one by one, so different texts under one doc_id stay or go by themselves, and
    of repeated rows one stays. Texts without words are copies of each other."""
    rows = common.saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    with common.folder_of_its_own(spark) as folder:
        found = similar.similar_components(rows.select("row", "text")).join(rows.select("row", "doc_id"), "row")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        # rows that are alone never move their texts: what goes is joined, not what stays
        several = found.groupBy("component").agg(first.alias("kept"), F.count("*").alias("n")).where("n > 1")
        gone = found.join(several.select("component", F.col("kept.row").alias("kept")), "component").where("row <> kept")
        gone = gone.select("row")
    gone = common.saved(gone)
    common.given_back(spark, folder)
    return rows.join(gone, "row", "left_anti").select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [SECRET] in place of every span that the secret scan reports; n_chars follows. Null texts stay null."""
    return secrets_scan.redacted(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence, see packing.pack_documents.

    Null texts count as empty: every document has a piece. Workers have other stages' memory too, so caches are small, and
    go with the task."""
    return packing.pack_documents(docs, cached=80_000, keep=False)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash_dedup", near), ("secret_scan", secrets), ("packing", pack)]

#: The classifier and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's table is written to the shared folder and read again, and given back
    when the next one is there, as are the tables that a stage made on its way."""
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        with common.folder_of_its_own(spark) as folder:
            result = stage(spark, docs, sf_dir)
        made = common.saved(result)
        common.given_back(spark, folder)
        if i:
            common.released(docs)
        docs = made
    return docs
