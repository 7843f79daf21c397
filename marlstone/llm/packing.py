"""Best-fit packing: a configuration linear program over the length histogram, by multiplicative weights."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PIECE = "doc_id long, piece int, start long, length long, ids binary"
#: The task that made a piece, and how many pieces of the same length it had made before.
RANKED = "part int, own long"
#: Rows of counts (a length in a part) up to which they are broadcast, some 20 MB.
BROADCAST = 200_000
UNIT = 16


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, from a cache of white-space-separated words.

    This tokenizer's words never span white space, so a text's ids are its words' ids one after the other. Of those, a
    run of Latin letters is one token sequence that ends in the only </w> token, whatever punctuation follows it, and
    case doesn't matter: so such runs are encoded many in one call, and once for all spellings."""

    LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")

    def __init__(self, path: str, cached: int = 300_000):
        # one thread: Spark runs a worker for each core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.known, self.runs, self.marks = {"": b""}, {}, {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        parts = {w: m for w in words if (m := self.LETTERS.fullmatch(w)) and "<|" not in w}
        runs = list({r for m in parts.values() if (r := m[1].lower()) not in self.runs})
        groups = [runs[at : at + 500] for at in range(0, len(runs), 500)]
        for some, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype="<u4")
            raw, start = ids.tobytes(), 0
            for r, end in zip(some, (np.flatnonzero(self.last[ids]) + 1).tolist(), strict=True):
                self.runs[r] = raw[4 * start : 4 * end]
                start = end
        for w in words:
            if m := parts.get(w):
                if m[2] not in self.marks:
                    self.marks[m[2]] = self._whole(m[2])
                self.known[w] = self.runs[m[1].lower()] + self.marks[m[2]]
            else:
                self.known[w] = self._whole(w)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 100):
            some = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts[at : at + 100]]
            if len(self.known) > self.cached:
                self.known = {"": b""}
            if len(self.runs) > 3 * self.cached:
                self.runs = {}
            new = set().union(*some).difference(self.known)
            if new:
                self._learn(list(new))
            known = self.known
            for words in some:
                yield b"".join([known[w] for w in words])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, cached: int = 300_000, keep: bool = True) -> DataFrame:
    """A row for each piece of at most capacity tokens: doc_id, piece, start, length, ids (little-endian, 32 bits each), and
    part and own, which number the pieces of one length within a task: save the table before using them.

    Ids are the tokenizer's without special tokens, then end_id; null texts count as empty (one id). A worker keeps
    its cache of words, of bounded size (cached words, and three times as many runs of letters), from task to task if keep says so."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda: WordEncoder(tokenizer, cached)
        encoder = common.kept_in_worker(("packing", tokenizer, cached), make) if keep else make()
        end, size = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        number, made = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for part in common.slices(batches, 250, keeps=keep):
            owner, cut = [], []
            for row, raw in enumerate(encoder.encode(part.column(1).to_pylist())):
                raw += end
                owner += [row] * -(-len(raw) // size)
                cut += [(at, raw[at : at + size]) for at in range(0, len(raw), size)]
            own = []
            for _, ids in cut:
                own.append(made[len(ids) // 4])
                made[len(ids) // 4] += 1
            out = [
                part.column(0).take(pa.array(owner, pa.int64())),
                pa.array([at // size for at, _ in cut], pa.int32()),
                pa.array([at // 4 for at, _ in cut], pa.int64()),
                pa.array([len(ids) // 4 for _, ids in cut], pa.int64()),
                pa.array([ids for _, ids in cut], pa.binary()),
                pa.array([number] * len(cut), pa.int32()),
                pa.array(own, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids", "part", "own"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(pieces, f"{PIECE}, {RANKED}")


def best_configuration(price: np.ndarray, size: np.ndarray, capacity: int) -> list[int]:
    """The multiset of items of greatest total price that fits (unbounded knapsack by dynamic programming)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(size, c, side="right")
        got = best[c - size[:fits]] + price[:fits]
        i = int(got.argmax()) if fits else -1
        if fits and got[i] > best[c - 1] + 1e-15:
            best[c], last[c] = got[i], i
        else:
            best[c] = best[c - 1]
    chosen, c = [], capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            chosen.append(int(last[c]))
            c -= int(size[last[c]])
    return chosen


def solve(size: np.ndarray, count: np.ndarray, capacity: int, rounds: int = 600, rate: float = 0.5) -> list[tuple[list[int], float]]:
    """The covering LP over configurations (every class covered count times, fewest bins), by multiplicative weights.

    Each round prices classes by their weights, lets the knapsack find the best configuration, and adds the amount of
    it that covers a share of the class it covers fastest; covered classes lose weight by that share. In the end all
    amounts are scaled so that no class is covered more often than it has pieces; the rest is for rounding."""
    weight, covered = np.ones(len(size)), np.zeros(len(size))
    amounts: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        chosen = best_configuration(weight / count, size, capacity)
        if not chosen:
            break
        uses = np.bincount(chosen, minlength=len(size))
        step = rate * 0.1 * (count[uses > 0] / uses[uses > 0]).min()
        amounts[tuple(chosen)] = amounts.get(tuple(chosen), 0.0) + step
        covered += step * uses / count
        weight *= np.exp(-rate * 10 * step * uses / count)
        weight = np.maximum(weight / weight.max(), 1e-12)
    scale = 1 / max(covered.max(), 1e-9)
    return sorted(((list(c), a * scale) for c, a in amounts.items()), key=lambda x: -x[1])


def plan(histogram: dict[int, int], capacity: int = 4096) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how many sequences have them; every piece is in exactly one.

    Lengths are classed by UNIT tokens for the LP. Its amounts are rounded down and filled with true lengths, largest
    first; what is left over, and the room left in these sequences, is packed best fit: the largest piece first, then
    again and again the largest that fits. All steps work on counts of equal patterns, never on single pieces."""
    left = {n: c for n, c in histogram.items() if c}
    if not left:
        return []
    done: list[tuple[tuple[int, ...], int]] = [((n,), left.pop(n)) for n in [capacity] if n in left]
    lengths = np.array(sorted(left), dtype=np.int64)
    if len(lengths):
        classes = -(-lengths // UNIT)
        size, where = np.unique(classes, return_inverse=True)
        count = np.bincount(where, weights=[left[int(n)] for n in lengths])
        pools = [[[int(n), left[int(n)]] for n in lengths[where == k][::-1]] for k in range(len(size))]
        for chosen, amount in solve(size, count, capacity // UNIT):
            times = int(min([amount, *(sum(c for _, c in pools[k]) // chosen.count(k) for k in set(chosen))]))
            while times > 0:
                pattern, used = [], {}
                for k in chosen:
                    n = next(n for n, c in pools[k] if c - used.get(n, 0) > 0)
                    used[n] = used.get(n, 0) + 1
                    pattern.append(n)
                have = {n: c for k in set(chosen) for n, c in pools[k]}
                k_times = min(times, *(have[n] // u for n, u in used.items()))
                for k in set(chosen):
                    pools[k] = [[n, c - k_times * used.get(n, 0)] for n, c in pools[k] if c - k_times * used.get(n, 0)]
                done.append((tuple(pattern), k_times))
                times -= k_times
        left = {n: c for pool in pools for n, c in pool}

    def largest(most: int) -> int:
        return max((n for n in left if n <= most), default=0)

    def filled(pattern: list[int], times: int) -> None:
        """Puts what fits into times sequences of one pattern, splitting them where a length runs out."""
        todo = [(pattern, times)]
        while todo:
            own, n_own = todo.pop()
            n = largest(capacity - sum(own))
            if not n:
                done.append((tuple(own), n_own))
                continue
            take = min(left[n], n_own)
            left[n] -= take
            if not left[n]:
                del left[n]
            if take < n_own:
                todo.append((own, n_own - take))
            todo.append(([*own, n], take))

    first, done = done, []
    for pattern, times in sorted(first, key=lambda x: sum(x[0]) - capacity):
        filled(list(pattern), times)
    while left:
        n = max(left)
        fit = max(1, capacity // n)
        times = max(1, left[n] // fit) if fit > 1 else left[n]
        use = min(fit, left[n])
        left[n] -= times * use
        if not left[n]:
            del left[n]
        filled([n] * use, times)
    return done


def numbered(pieces: DataFrame, rows_per_cell: int = 4096) -> DataFrame:
    """Adds part and own to pieces that don't have them: numbers within cells of a length, by doc_id (nulls too), piece and
    start, so that no task holds all pieces of a length. Columns of these names are replaced."""
    cells = max(1, min(4096, -(-pieces.count() // rows_per_cell)))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)).cast("int"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start")
    return dealt.withColumn("own", F.row_number().over(own).cast("long") - 1)


def packed(pieces: DataFrame, capacity: int = 4096, broadcast: int = BROADCAST) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0 in each sequence) to pieces: a saved table with doc_id, piece, start,
    length, part, own (see token_pieces, numbered) and any other columns (those named sequence_id or offset are replaced);
    part and own go.

    The driver gets counts of at most capacity lengths and gives back runs: pieces of one length and a range of ranks
    go to one slot of one pattern. A piece's rank is its own number and the count of its length in the parts before, so
    only counts are shuffled and pieces stay where they were written, unless there are more than broadcast counts: then
    pieces are joined to them by part and length. Which pieces of one length share a sequence isn't fixed. Repeated rows
    are pieces like others; an empty table gives no rows."""
    counts = common.saved(pieces.groupBy("length", "part").count())
    sums = counts.groupBy("length").agg(F.sum("count").alias("n"), F.count("*").alias("parts")).collect()
    histogram = {r["length"]: r["n"] for r in sums}
    runs, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in plan(histogram, capacity):
        at = 0
        for length in pattern:
            runs.append((length, used[length], used[length] + times, sequence - used[length], at))
            used[length] += times
            at += length
        sequence += times
    starts: dict[int, list] = {}
    for length, first, _, shift, at in runs:
        starts.setdefault(length, []).append((first, shift, at))
    spark = pieces.sparkSession
    kept = pieces.drop("sequence_id", "offset", "part", "own").columns
    table = [(length, [s[0] for s in x], [s[1] for s in x], [s[2] for s in x]) for length, x in starts.items()]
    places = spark.createDataFrame(table, "length long, firsts array<long>, shifts array<long>, ats array<long>")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    if sum(r["parts"] for r in sums) <= broadcast:
        shifted = F.broadcast(shifted)
    ranked = pieces.join(shifted, ["length", "part"]).withColumn("_rank", F.col("_before") + F.col("own"))
    # at most capacity rows and, in all, as many runs as the patterns have slots: counts of patterns, not of pieces
    found = (
        ranked
        .join(F.broadcast(places), "length")
        .withColumn("_run", F.size(F.filter("firsts", lambda x: x <= F.col("_rank"))) - 1)
    )
    sequence = (F.get("shifts", F.col("_run")) + F.col("_rank")).alias("sequence_id")
    return found.select(*kept, sequence, F.get("ats", F.col("_run")).alias("offset"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, cached: int = 300_000, keep: bool = True) -> DataFrame:
    """A row for each piece of each document (see token_pieces), with its ids, sequence_id and offset (see packed).

    Null and empty texts are one id, the end's; longer ones than a sequence are cut into pieces. Null doc_ids
    are like others; repeated rows are pieces of their own. Other columns of docs aren't
    read, whatever their names. An empty table gives no rows."""
    return packed(common.saved(token_pieces(docs, tokenizer or tokenizer_path(), cached=cached, keep=keep)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed pieces, as pack_documents does it (see there for nulls, empty and long texts, ties, repeated
    rows, empty tables and other columns); ids are reduced to their digest before they are placed."""
    pieces = token_pieces(common.documents(spark, sf_dir), tokenizer_path())
    return packed(common.saved(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))
