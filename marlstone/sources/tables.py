"""Tables as parquet folders, and over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(df: DataFrame, folder: str, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Bulk load: writes df as the table name of a folder, in place of an older one, and reads it back."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{folder}/{name}.parquet")
    return table(df.sparkSession, folder, name)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A database table, read in ranges of an integer key if its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def restore_missing(stored: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """stored and the rows of backup whose key it doesn't have. A null key counts as a key: rows with it come back if
    stored has none, so that restoring twice adds nothing. Repeated rows of the backup come back as they are."""
    kept, back = stored.select(F.col(key).alias("_key")), backup.withColumn("_sought", F.col(key))
    missing = back.join(kept, F.col("_sought").eqNullSafe(F.col("_key")), "left_anti")
    return stored.unionByName(missing.drop("_sought"))
