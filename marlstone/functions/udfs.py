"""User functions of each kind that Spark has: scalar over batches, aggregate, and table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


@pandas_udf(LongType())
def vowels(texts: pd.Series) -> pd.Series:
    """How many of a, e, i, o, u a text has."""
    return texts.str.count("[aeiou]")


@pandas_udf(DoubleType())
def spread(values: pd.Series) -> float:
    """Greatest less least: an aggregate of a group."""
    return float(values.max() - values.min())


@udtf(returnType=StructType([StructField("pos", IntegerType()), StructField("word", StringType())]))
class Words:
    """A row for each word of a text, with its place."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split())


def register(spark: SparkSession) -> None:
    spark.udtf.register("words_of", Words)
