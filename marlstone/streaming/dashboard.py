"""A kept dashboard: aggregates of a stream that a table holds, right after any replay or restart.

Each batch's partial aggregates go to a folder of the batch's number, in place of what an earlier try of it left; now and
then they are merged into a base, which is named after the last batch in it. What is read is the base and the batches
after it. A batch that comes again either overwrites its own folder or is in the base already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Dashboard:
    """Counts and sums by keys in folder, which executors share; measures are columns of whole numbers (of floating
    point, sums would depend on the order). One stream writes it; any session may read.

    Null keys are a group, null measures count as nothing. Rows that a batch repeats count each. Before the first batch
    the table is empty."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], measures: list[str], every: int = 20):
        self.spark, self.folder, self.keys, self.measures, self.every = spark, folder, keys, measures, every

    def merge(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        base = self._base()
        if number <= base:
            return
        sums = [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in self.measures]
        part = batch.groupBy(*self.keys).agg(F.count("*").alias("n"), *sums)
        # a batch has as many groups as the dashboard has cells at most, so few files
        part.coalesce(8).write.mode("overwrite").parquet(f"{self.folder}/parts/{number}")
        if number - base >= self.every:
            self._compact(number)

    def table(self) -> DataFrame:
        """keys, n and measures."""
        return self._sum(self._base(), None)

    def _sum(self, base: int, through: int | None) -> DataFrame:
        parts = [n for n in self._whole("parts") if n > base and (through is None or n <= through)]
        paths = [f"{self.folder}/base/{base}"] * (base >= 0) + [f"{self.folder}/parts/{n}" for n in parts]
        if not paths:
            return self.spark.createDataFrame([], ", ".join([*(f"{k} string" for k in self.keys), "n long", *(f"{m} long" for m in self.measures)]))
        rows = self.spark.read.parquet(*paths)
        return rows.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in ("n", *self.measures)))

    def _compact(self, through: int) -> None:
        before = self._base()
        self._sum(before, through).write.mode("overwrite").parquet(f"{self.folder}/base/{through}")
        # readers that began with the base before have until the next compaction: what goes now is older
        for kind in ("base", "parts"):
            for n in self._whole(kind):
                if n < before or (kind == "parts" and n == before):
                    self._delete(f"{self.folder}/{kind}/{n}")

    def _base(self) -> int:
        return max(self._whole("base"), default=-1)

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _whole(self, kind: str) -> list[int]:
        """Numbers of the folders whose writing ended; at most 2 * every parts and two bases are there."""
        fs, at = self._fs(f"{self.folder}/{kind}")
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(p.getName()) for p in found if fs.exists(self._fs(f"{p.toString()}/_SUCCESS")[1]))

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)
