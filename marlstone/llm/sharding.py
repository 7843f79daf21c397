"""Sharding by histogram sort: splitters of near equal bytes, then one exchange."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DOC_BITS = 24


def content_key(text: Column, doc_id: Column) -> Column:
    """A sort key of 63 bits: the high bits are the text's, the low 24 bits the doc_id's.

    Equal texts are neighbours, and a text with a third of all rows can still be cut between its documents."""
    low = (1 << DOC_BITS) - 1
    high = F.shiftrightunsigned(F.xxhash64(text), 1).bitwiseAND(F.lit(((1 << 63) - 1) ^ low))
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(doc_id), 1).bitwiseAND(F.lit(low)))


def splitters(rows: DataFrame, key: str, size: str, shards: int, tolerance: float, probes: int) -> list[int]:
    """Keys that cut the rows into shards of near equal size.

    Each pass counts the exact size of every probe cell inside the open intervals (at most shards x probes sums come
    to the driver) and keeps, for each splitter, the cell that its target falls in. A splitter is done when a cell
    boundary is within tolerance x the mean shard, or when the cell is a single key."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    targets = [total * (i + 1) / shards for i in range(shards - 1)]
    open_at = dict.fromkeys(range(shards - 1), (0, 1 << 63, 0))  # splitter: from, to, size below from
    found: dict[int, int] = {}
    while open_at:
        spans = sorted({(lo, hi, below) for lo, hi, below in open_at.values()})
        steps = [max(1, -(-(hi - lo) // probes)) for lo, hi, _ in spans]
        k = F.col(key)
        span = F.lit(None).cast("int")
        for i, (lo, hi, _) in enumerate(spans):
            inside = k >= F.lit(lo) if hi >> 63 else (k >= F.lit(lo)) & (k < F.lit(hi))
            span = F.when(inside, F.lit(i)).otherwise(span)
        low, step = (F.array(*map(F.lit, x)) for x in ([lo for lo, _, _ in spans], steps))
        counted = (
            rows.select(key, size, span.alias("span"))
            .where("span is not null")
            .select(key, size, "span", F.get(low, F.col("span")).alias("got_low"), F.get(step, F.col("span")).alias("got_step"))
            .groupBy("span", F.expr(f"({key} - got_low) div got_step").alias("cell"))
            .agg(F.sum(size).alias("bytes"))
            .collect()
        )
        cells: dict[int, dict[int, int]] = {}
        for r in counted:
            cells.setdefault(r["span"], {})[r["cell"]] = r["bytes"]
        index = {s: i for i, s in enumerate(spans)}
        for i, at in list(open_at.items()):
            lo, hi, below = at
            own = index[at]
            n = -(-(hi - lo) // steps[own])
            ends = [below, *(below + x for x in accumulate(cells.get(own, {}).get(c, 0) for c in range(n)))]
            c = min(max(bisect_left(ends, targets[i]) - 1, 0), n - 1)
            a, b = lo + c * steps[own], min(hi, lo + (c + 1) * steps[own])
            near = min((targets[i] - ends[c], a), (ends[c + 1] - targets[i], b))
            if near[0] <= tolerance * total / shards or b - a <= 1:
                found[i] = near[1]
                del open_at[i]
            else:
                open_at[i] = (a, b, ends[c])
    return [found[i] for i in range(shards - 1)]


def histogram_shards(
    rows: DataFrame,
    key: str,
    size: str,
    order: list[str],
    shards: int = 24,
    tolerance: float = 2e-4,
    probes: int = 128,
    rows_per_cell: int = 4096,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Adds shard (0 to shards - 1; near equal sums of size) and slot (gapless from 0 in each shard) to rows.

    keys, a saved table of the columns key, size and order, is read several times; rows (keys itself, if not given) once,
    and only that pass moves it. A shard's rows are spread over cells by a hash of the columns of order, so that no task
    holds a whole shard; cells, at most 1000 a shard, follow each other in the slots. Rows that share a key stay in one
    shard (repeated rows with one doc_id and text do); ties in a shard's order are broken at random; an empty table gives
    an empty result; nulls in order are ordinary values. Columns named shard or slot are replaced, others kept; names
    that begin with _shard_ are the operator's own."""
    keys = rows if keys is None else keys
    cuts = [min(x, (1 << 63) - 1) for x in splitters(keys, key, size, shards, tolerance, probes)]
    cells = max(1, min(1000, -(-keys.count() // (shards * rows_per_cell))))
    place = {
        "shard": common.interval_of(F.col(key), cuts).cast("int"),
        "_shard_cell": F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"),
    }
    before = Window.partitionBy("shard").orderBy("_shard_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = keys.withColumns(place).groupBy("shard", "_shard_cell").count()
    offsets = counts.select("shard", "_shard_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shard_offset"))
    own = Window.partitionBy("shard", "_shard_cell").orderBy(key, *order)
    ranked = rows.withColumns(place).withColumn("_shard_rank", F.row_number().over(own))
    # at most 1000 x shards rows are broadcast
    ranked = ranked.join(F.broadcast(offsets), ["shard", "_shard_cell"])
    ranked = ranked.withColumn("slot", F.col("_shard_offset") + F.col("_shard_rank") - 1)
    return ranked.drop("_shard_cell", "_shard_offset", "_shard_rank")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """All columns of docs (doc_id, text and others), and shard and slot: near equal bytes of text, 8 for each row.

    To keep the shards: write it with partitionBy("shard"). Null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    key, size = common.unused(docs, "_key"), common.unused(docs, "_size")
    added = {key: content_key(text, F.col("doc_id")), size: (F.octet_length(text) + 8).cast("long")}
    whole = docs.withColumns(added)
    keys = common.saved(whole.select(key, size, "doc_id"))
    return histogram_shards(whole, key, size, ["doc_id"], shards, keys=keys).drop(key, size)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes. A null text counts as empty (crc32 of no bytes is 0).

    Texts of any length are measured whole, and stay where they are: only sizes and keys move. For ties, repeated rows,
    null ids, empty tables and other columns see histogram_shards."""
    text = F.coalesce("text", F.lit(""))
    rows = common.saved(
        common.documents(spark, sf_dir).select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            content_key(text, F.col("doc_id")).alias("key"),
        )
    )
    placed = histogram_shards(rows, "key", "size", ["doc_id"])
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
