"""Keyword ranking by BM25 over an inverted index with bounds that let whole cells be skipped, and fusion with other ranks.

The index is a table of postings: a row for each term and cell, with the documents of the cell that have the term, how
often they have it and how long they are. What a term adds to a score grows with the first and falls with the second, so
the greatest count and the least length of a row bound it. Cells hold documents of about one length. A query first adds
up the bounds of its terms in each cell, without reading postings; the most promising cells give a threshold, and then
only cells whose bound reaches it are read. Results are exact.

Texts are shuffled once, by slice of documents, and all of a slice's rows are made where it is; rows are shuffled once
more, to the files of their bucket. A query shuffles the rows of its terms, by cell, not what they hold by document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75


@dataclass
class KeywordIndex:
    """postings: see SCHEMA. n, mean: documents, and their mean length in tokens."""

    postings: DataFrame
    n: int
    mean: float

    def impact(self, df: Column, tf: Column, length: Column) -> Column:
        return impact(F.lit(float(self.n)), df, tf, length, F.lit(self.mean))


def impact(n: Column, df: Column, tf: Column, length: Column, mean: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def rows_of(docs: DataFrame, slices: int) -> DataFrame:
    """term, cell, ids, tfs, lens: a row for each term and cell, from one shuffle of the texts.

    Rows of one doc_id are one document; null doc_ids have none. A slice is some documents of any length, and has a cell
    for each power of two that lengths are in. All groups and windows are within a slice, so they stay in its
    task."""
    dealt = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"))
    words = dealt.repartitionById(slices, "slice").select("slice", "doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    counts = words.groupBy("slice", "doc_id", "term").agg(F.count("*").cast("int").alias("tf"))
    counts = counts.withColumn("len", F.sum("tf").over(Window.partitionBy("slice", "doc_id")).cast("int"))
    cell = F.floor(F.log2("len")) * slices + F.col("slice")
    found = counts.groupBy("slice", cell.alias("cell"), "term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf", "len"))).alias("p"))
    return found.select("term", "cell", F.col("p.doc_id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"))


def write_index(docs: DataFrame, folder: str, buckets: int = 64, cell_docs: int = 2048) -> KeywordIndex:
    """Builds and writes the index of docs (doc_id, text), in place of an older one there, and reads it back.

    Postings are in folders by bucket, a hash of the term, so a query reads its terms' buckets alone. A cell has at most
    about cell_docs documents, a bound on each row's arrays however common a term is. Texts without tokens are in no
    posting but count as documents. An empty table gives an empty index."""
    n = docs.where("doc_id is not null").select("doc_id").distinct().count()
    share = max(1, -(-n // cell_docs))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    # a bucket, and a term that is very common, are written by several tasks where documents are many
    slot = F.pmod(F.xxhash64("term", "cell"), F.lit(max(1, min(1024, share // 16))))
    placed = rows_of(docs, share).withColumn("bucket", bucket).repartition("bucket", slot).sortWithinPartitions("bucket", "term", "cell")
    tokens_there = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    told = {"n": F.size("ids").cast("long"), "tokens": tokens_there, "most": F.array_max("tfs"), "least": F.array_min("lens")}
    placed.withColumns(told).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    spark = docs.sparkSession
    total = _postings(spark, folder).agg(F.sum("tokens")).first()[0] or 0
    spark.createDataFrame([(n, total)], STATS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    return read_index(spark, folder)


SCHEMA = "term string, cell long, n long, tokens long, most int, least int, ids array<long>, tfs array<int>, lens array<int>, bucket int"
STATS = "n long, tokens long"


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{folder}/postings")


def read_index(spark: SparkSession, folder: str) -> KeywordIndex:
    n, total = spark.read.schema(STATS).parquet(f"{folder}/stats").first()
    return KeywordIndex(_postings(spark, folder), n, total / max(n, 1))


def bm25_top(index: KeywordIndex, queries: DataFrame, k: int = 10, buckets: int = 64, first: int = 2, told: dict | None = None, most: int = 200_000) -> DataFrame:
    """query_id, doc_id, score (rounded to 6 places), rank of the k best documents of each query (query_id, text) that share a
    term with it; ties by doc_id. A term counts once, however often a query has it; null queries find nothing.

    first: how many cells give a query's threshold. In told, if given, cells that queries could read and do read are
    counted. The terms of queries are sent to all tasks if they are at most `most`; more are joined as Spark chooses."""
    asked = queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct()
    sent = F.broadcast if asked.count() <= most else lambda df: df
    own = ["bucket", "term"]
    df = index.postings.select(*own, "n").join(sent(asked.select(own).distinct()), own, "left_semi").groupBy(own).agg(F.sum("n").alias("df"))
    terms = asked.groupBy(own).agg(F.collect_list("query_id").alias("by")).join(df, own).persist()
    heads = index.postings.select(*own, "cell", "most", "least").join(sent(terms), own)
    bound = heads.select("cell", "by", index.impact(F.col("df"), F.col("most"), F.col("least")).alias("top")).repartition("cell")
    bounds = bound.select("cell", F.explode("by").alias("query_id"), "top").groupBy("query_id", "cell").agg(F.sum("top").alias("bound")).persist()

    def scored(cells: DataFrame, few: bool) -> DataFrame:
        """The rows of the queries' terms come together by cell; few: those of other cells are left out before that."""
        wanted = cells.groupBy("cell").agg(F.collect_list("query_id").alias("here"))
        found = index.postings.select(*own, "cell", "ids", "tfs", "lens").join(sent(terms.select(own)), own, "left_semi")
        found = found.join(sent(wanted), "cell") if few else found.repartition("cell").join(wanted, "cell")
        found = found.join(sent(terms), own).withColumn("by", F.array_intersect("by", "here")).where(F.size("by") > 0)
        found = found.select("cell", "by", "df", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("x"))
        found = found.select("cell", "by", F.col("x.ids").alias("doc_id"), index.impact(F.col("df"), F.col("x.tfs"), F.col("x.lens")).alias("impact"))
        found = found.select("cell", F.explode("by").alias("query_id"), "doc_id", "impact")
        return found.groupBy("cell", "query_id", "doc_id").agg(F.round(F.sum("impact"), 6).alias("score")).drop("cell")

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
    start = bounds.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= first).select("query_id", "cell")
    early = best(scored(start, True)).persist()
    least = early.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    # a bound may be lost in rounding by less than a millionth
    rest = bounds.join(start, ["query_id", "cell"], "left_anti").join(least, "query_id", "left")
    rest = rest.where(F.col("n").isNull() | (F.col("n") < k) | (F.col("bound") + 1e-6 >= F.col("least"))).select("query_id", "cell")
    if told is not None:
        told |= {"cells": bounds.count(), "read": start.count() + rest.count()}
    return best(early.drop("rank").unionByName(scored(rest, False))).select("query_id", "doc_id", "score", "rank")


def hybrid(a: DataFrame, b: DataFrame, key: str, k: int = 10, constant: int = 60) -> DataFrame:
    """query_id, key, score of the k best of each query by reciprocal rank fusion of two lists (query_id, key, rank); ties by
    key. A list's rows without a partner count by that list alone."""
    part = lambda c: F.coalesce(1 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    side = lambda x, c: x.select("query_id", key, F.col("rank").alias(c))
    both = side(a, "_a").join(side(b, "_b"), ["query_id", key], "full").select("query_id", key, F.round(part("_a") + part("_b"), 8).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
