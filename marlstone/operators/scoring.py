"""Scores: a label if there is one, else a rule or a model; bands."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import chunks
from ..sources.shared import new_folder, written

BANDS = [(0.2, "none"), (0.4, "low"), (0.6, "medium"), (0.8, "high")]
Scorer = Callable[[pd.Series], pd.Series]


def rule_score(text: Column, lexicon: list[str]) -> Column:
    """The share of the list's words that a text contains."""
    found = F.size(F.filter(F.array(*map(F.lit, lexicon)), lambda w: text.contains(w)))
    return found / len(lexicon)


def chunk_scores(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """doc_id, rule: the greatest score of a document's chunks; a null text has a null one."""
    score = F.transform(chunks(F.col("text")), lambda c: rule_score(c, lexicon))
    return docs.select("doc_id", F.round(F.array_max(score), 6).alias("rule"))


def one_label(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: the greatest label of each document, so that repeated ones don't repeat documents; null ones don't
    count, nor do labels of no document."""
    known = labels.where("doc_id is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def label_or_rule(docs: DataFrame, labels: DataFrame, lexicon: list[str]) -> DataFrame:
    """doc_id, score, by_rule for every row of docs: the document's label (see one_label), else chunk_scores' rule. Rows with
    a null doc_id have no label, repeated rows stay, and a null text without a label has a null score."""
    scored = chunk_scores(docs, lexicon).join(one_label(labels), "doc_id", "left")
    return scored.select(
        "doc_id",
        F.coalesce(F.col("toxic").cast("double"), "rule").alias("score"),
        F.col("toxic").isNull().alias("by_rule"),
    )


def judged(docs: DataFrame, labels: DataFrame, by: str | Scorer = "rule", lexicon: list[str] | None = None, calls: int | None = None) -> DataFrame:
    """doc_id, score: a label if there is one, else what by says: "rule" (the word list's) or a scorer, such as a model
    of any provider behind a service, of which at most calls run at once. Labelled documents aren't sent to it.

    Labels are those of one_label; rows with a null doc_id have none, and repeated rows stay."""
    if by == "rule":
        return label_or_rule(docs, labels, lexicon or []).select("doc_id", "score")
    labels = one_label(labels)
    known = docs.select("doc_id").join(labels.select("doc_id", F.col("toxic").cast("double").alias("score")), "doc_id")
    rest = docs.select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_anti")
    return known.unionByName(with_scorer(rest, by, calls=calls).select("doc_id", "score"))


def band(score: Column, bands: list[tuple[float, str]] = BANDS, top: str = "severe") -> Column:
    """The band's name; null for a null score and for one that isn't a number."""
    out = F.lit(top)
    for limit, name in reversed(bands):
        out = F.when(score < limit, F.lit(name)).otherwise(out)
    return F.when(score.isNotNull() & ~F.isnan(score), out)


#: Bytes of text for one task where few tasks may run at once.
TASK_BYTES = 128 << 20


def in_waves(df: DataFrame, text: str, calls: int, share: Column, bytes_each: int, work: Callable[[DataFrame], DataFrame], total: int | None = None) -> DataFrame:
    """work(df), where at most `calls` tasks may run at once and none may read more than about bytes_each of text: rows are
    dealt into waves by share, a whole number, which are worked on one after the other and written. A small df is one wave. total: bytes of text, if known."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] if total is None else total
    waves = -(-(total or 0) // (calls * bytes_each))
    if waves < 2:
        return work(df)
    spark, folder, name = df.sparkSession, new_folder(df.sparkSession), f"wave{uuid.uuid4().hex}"
    df.withColumn(name, F.pmod(share, F.lit(waves)).cast("int")).write.partitionBy(name).parquet(folder)
    rows = spark.read.schema(StructType([*df.schema.fields, StructField(name, IntegerType())])).parquet(folder)
    return reduce(DataFrame.unionByName, (written(work(rows.where(F.col(name) == i).drop(name))) for i in range(waves)))


def with_scorer(df: DataFrame, scorer: Scorer, text: str = "text", calls: int | None = None, rows: int = 500, bytes_each: int = TASK_BYTES) -> DataFrame:
    """Adds score by a function over batches of texts (at most rows in each), such as a model behind a service; at most calls
    run at once, over waves of rows where a task would read much more than bytes_each."""
    schema = df.withColumn("score", F.lit(None).cast("double")).schema
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                columns = dict(zip(part.schema.names, part.columns))
                columns["score"] = pa.array(scorer(part.column(at).to_pandas()).astype("float64"), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], schema.names)
            del batch
            pa.default_memory_pool().release_unused()

    if not calls:
        return df.mapInArrow(run, schema)
    return in_waves(df, text, calls, F.monotonically_increasing_id(), bytes_each, lambda x: x.repartition(calls).mapInArrow(run, schema))


def with_ledger(df: DataFrame, scorer: Scorer, folder: str, text: str = "text", rows: int = 64, calls: int | None = None, bytes_each: int = TASK_BYTES) -> DataFrame:
    """Adds score as with_scorer does, and pays for each text once: for repeated texts, after lost tasks, and in later
    runs over the same table.

    Different texts are put into batches by their digest, at most rows in each, whatever task has them. A batch's answers
    are written to folder, which executors share, under the digest of its texts before the next batch is asked for; a
    task that starts again, or another run, finds them there. A batch that fails leaves nothing. Two tries of one task at
    once may ask twice; both answers are whole files, and the later one stays.

    Null texts aren't sent and have a null score; an empty table asks nothing; repeated rows stay. calls: at most so many
    run at once, which is the number of tasks of a wave (see in_waves); as answers are kept, a long task that is lost only reads them again."""
    key = F.sha2(F.col(text).cast("binary"), 256)
    texts = df.where(F.col(text).isNotNull()).select(key.alias("_digest"), F.col(text).alias("_text")).dropDuplicates(["_digest"])
    # the number only sets how full the batches are, the bytes how many waves there are
    n, total = df.agg(F.approx_count_distinct(key), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    batch = F.pmod(F.xxhash64("_digest"), F.lit(1 << (n * 2 // rows).bit_length()))
    texts = texts.withColumn("_batch", batch)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(at)
        held = pd.DataFrame()
        for frame in frames:
            # a batch may go on in the next frame, so its last one waits
            held = pd.concat([held, frame]) if len(held) else frame
            last = held["_batch"].iloc[-1] if len(held) else None
            for _, part in held[held["_batch"] != last].groupby("_batch", sort=False):
                yield from answered(part, fs, at)
            held = held[held["_batch"] == last]
        for _, part in held.groupby("_batch", sort=False) if len(held) else ():
            yield from answered(part, fs, at)

    def answered(batch: pd.DataFrame, fs: pafs.FileSystem, at: str) -> Iterator[pd.DataFrame]:
        for start in range(0, len(batch), rows):
            part = batch.iloc[start : start + rows]
            path = f"{at}/{hashlib.sha256(''.join(part['_digest']).encode()).hexdigest()}"
            if fs.get_file_info(path).type == pafs.FileType.File:
                with fs.open_input_file(path) as file:
                    scores = pa.ipc.open_file(file).read_all().column("score").to_numpy()
            else:
                scores = scorer(part["_text"]).astype("float64").to_numpy()
                trial = f"{path}.{uuid.uuid4().hex}"
                answers = pa.table({"score": scores})
                with fs.open_output_stream(trial) as file, pa.ipc.new_file(file, answers.schema) as to:
                    to.write_table(answers)
                fs.move(trial, path)  # a whole file or none
            yield pd.DataFrame({"_digest": part["_digest"].to_numpy(), "score": scores})

    def asked(x: DataFrame) -> DataFrame:
        dealt = (x.repartition(calls, "_batch") if calls else x.repartition("_batch")).sortWithinPartitions("_batch", "_digest")
        return dealt.mapInPandas(run, "_digest string, score double")

    # a batch is in one wave
    scores = in_waves(texts, "_text", calls, F.xxhash64("_batch"), bytes_each, asked, total) if calls else asked(texts)
    return df.withColumn("_digest", key).join(scores, "_digest", "left").drop("_digest")
