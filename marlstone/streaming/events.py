"""Windows over events, batch and streaming; ts must be a timestamp (cast timestamp_ntz first)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import new_folder


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, event_type, n, total; on a stream give the watermark's delay."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        rows
        .groupBy(w.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return (
        rows
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), "n")
    )


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def read_table(spark: SparkSession, folder: str, name: str, files: int | None = None) -> DataFrame:
    """A stream of the table of that name in a folder, whether it is one file or a folder of files; at most so many files a
    batch if files is given."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # as a pattern, since a stream's path may match one file but not be one
    return reader.parquet(f"{folder}/{name}.parque[t]")


def read_events(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    return read_table(spark, folder, "events", files).withColumn("ts", F.col("ts").cast("timestamp"))


def totals(events: DataFrame) -> DataFrame:
    """user_id, n, total so far, of every user that a batch brings: state of our own, kept for each user."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    kept = "user_id long, n long, total double"
    return (
        events
        .groupBy("user_id")
        .applyInPandasWithState(add, kept, "n long, total double", "update", GroupStateTimeout.NoTimeout)
    )


def late_rows(running: StreamingQuery) -> int:
    """Rows that came after the watermark in the batches whose progress is kept (rows of partial aggregates, where a stage
    before the state makes them)."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in running.recentProgress for s in p["stateOperators"])


def run_to_end(stream: DataFrame, mode: str, out: str | None = None, at: str | None = None, told: dict[str, int] | None = None) -> DataFrame:
    """Runs a stream over all that its source has now and reads what it wrote to the shared folder.

    complete: the last batch's whole table. update: all batches' rows, in batch order by the column batch. append: as the
    sink has them. Nothing is gathered in the driver, and a restart goes on from the checkpoint.

    out, at: folders of the result and the checkpoint, new ones if not given. told: gets late, see late_rows."""
    spark = stream.sparkSession
    out, at = out or new_folder(spark), at or new_folder(spark)

    def to_the_end(running: StreamingQuery) -> None:
        running.awaitTermination()
        if told is not None:
            told["late"] = late_rows(running)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True)
    if mode == "append":
        to_the_end(writer.format("parquet").option("path", out).start())
        return spark.read.schema(stream.schema).parquet(out)

    def write(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # the folder's name is the column

    to_the_end(writer.foreachBatch(write).start())
    return spark.read.parquet(out)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds value as of at: the right side's latest at or before it, by one window over both sides."""
    both = (
        left
        .withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)})
        .unionByName(
            right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_side")),
            allowMissingColumns=True,
        )
    )
    before = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"{value}_as_of", F.last("_v", ignorenulls=True).over(before)).where("_side = 1").drop("_v", "_side")
