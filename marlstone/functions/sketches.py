"""Sketches that are kept by day and merged later: distinct counts (HLL) and quantiles (KLL), all in built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of HLL buckets (relative standard error 1.04 / sqrt(2 ** bits), about 1.6 %) and KLL's k (rank error about 1 %).
BITS, K = 12, 300


def daily(rows: DataFrame, by: list[str], counted: str, measured: str, at: str = "ts") -> DataFrame:
    """by, day, n, users, quantiles: one row a day, of bounded size whatever the number of rows. Null and absent values are
    in neither sketch; a day without any has an empty one."""
    return (
        rows
        .groupBy(*by, F.to_date(at).alias("day"))
        .agg(
            F.count("*").alias("n"),
            F.hll_sketch_agg(counted, BITS).alias("counted"),
            F.kll_sketch_agg_double(F.col(measured).cast("double"), K).alias("measured"),
        )
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of any days or parts, made one: by, n, counted, measured. Shuffles sketches, not rows."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("counted").alias("counted"), F.kll_merge_agg_double("measured").alias("measured")
    )


def estimates(sketches: DataFrame, by: list[str], ranks: list[float]) -> DataFrame:
    """by, n, distinct, quantiles: an array in the order of ranks; null where nothing was measured."""
    some = F.kll_sketch_get_n_double("measured") > 0
    found = F.when(some, F.kll_sketch_get_quantile_double("measured", F.array(*map(F.lit, ranks))))
    return sketches.select(*by, "n", F.hll_sketch_estimate("counted").alias("distinct"), found.alias("quantiles"))
