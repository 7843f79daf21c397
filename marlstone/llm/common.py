"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import given_back, new_folder, run_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "\t\n\x0b\x0c\r"


#: The folder that saved() uses instead of the run folder: each thread of the driver has its own.
_within: ContextVar[str | None] = ContextVar("_within", default=None)


@contextmanager
def folder_of_its_own(spark: SparkSession) -> Iterator[str]:
    """What saved() writes meanwhile in this thread goes to one folder, which given_back() empties as a whole."""
    before = _within.set(new_folder(spark))
    try:
        yield _within.get()
    finally:
        _within.reset(before)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of a row group, which a writing task holds in its JVM, and a reading one by columns.
GROUP, GROUP_BYTES = "parquet.block.size", 32 << 20


def saved(df: DataFrame, batch: int = 1000) -> DataFrame:
    """Writes df to the run folder and reads it back: cuts lineage and survives lost executors.

    Meanwhile Arrow batches have at most batch rows, as the JVM and Python workers both hold them, two at a time. Row
    groups have at most GROUP_BYTES.

    The files stay until released() or sources.shared.clean(), as results are read from them later."""
    path = f"{_within.get()}/{uuid.uuid4().hex}" if _within.get() else new_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(BATCH)
    conf.set(BATCH, min(int(before), batch) if int(before) > 0 else batch)
    try:
        df.write.option(GROUP, GROUP_BYTES).parquet(path)
    finally:
        conf.set(BATCH, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Gives back the files of a table made by saved(); nothing may read it any more. An empty table may have none."""
    run = run_dir(df.sparkSession)
    for file in df.inputFiles()[:1]:
        # a file's URI may be written with one slash after the scheme, and with three
        within = file.partition(f"/{run.rpartition('/')[2]}/")[2]
        if within:
            given_back(df.sparkSession, f"{run}/{within.rpartition('/')[0]}")


#: What a worker keeps from task to task: one operator's caches at a time.
_kept: dict[tuple, object] = {}


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """make()'s result, made once in a worker as long as no other key is asked for."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def trim() -> None:
    """Memory that the C library holds for later goes back to the system, where it can: other workers may need it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """Arrow batches (Spark bounds them by bytes) in parts of at most rows rows, so that the Python objects of few
    texts live at once; memory that Arrow doesn't use goes back after each batch, and all that is free before a task and
    after it. An operator that doesn't keep caches in its worker drops those of others."""
    if not keeps:
        _kept.clear()
    trim()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
    trim()


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no column of that name (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. For pure ASCII that is lower(), which is faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def interval_of(key: Column, thresholds: Sequence[int], first: int = 0) -> Column:
    """How many of the ascending thresholds are <= key, as a balanced tree of comparisons; keep it to some hundred."""
    if not thresholds:
        return F.lit(first)
    mid = len(thresholds) // 2
    return F.when(key < F.lit(thresholds[mid]), interval_of(key, thresholds[:mid], first)).otherwise(
        interval_of(key, thresholds[mid + 1 :], first + mid + 1)
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
