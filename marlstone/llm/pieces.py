"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
FAR = np.int64(1 << 40)
CODED = "doc_id long, ids array<int>, decoded string"


class PieceCoder:
    """Encodes as the sentencepiece library does with a BPE model of byte fallback, a dummy prefix and no normalising.

    No piece has the space mark after another character, so a text falls into words (marks, then other characters)
    that never merge with each other. A symbol is a piece's id, or, for a character without a piece, the vocabulary's
    size plus its code point."""

    WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __init__(self, model_file: str, cached: int = 150_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space mark after another character")
        self.byte_ids = [0] * 256
        self.raw = [i.to_bytes(4, "little") for i in range(n)]
        self.text = [p.replace(SPACE, " ").encode() for p in names]
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(names[i][1:-1], 16)] = i
                self.text[i] = bytes([int(names[i][1:-1], 16)])
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.symbol(p[:k]), self.symbol(p[k:])
                if a is not None and b is not None:
                    pairs[a << 22 | b] = i
        self.rank = np.full(n + 1, FAR, dtype=np.int64)
        for r, i in enumerate(sorted(self.ids.values(), key=lambda i: -model.get_score(i))):
            self.rank[i] = r
        self._hash(np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int64))
        # whether a piece is half of a piece of lower rank: merging many at once could then miss a better pair
        self.hasty = np.zeros(n + 1, dtype=bool)
        for key, i in pairs.items():
            for half in (key >> 22, key & 0x3FFFFF):
                if half < n and self.rank[i] < self.rank[half]:
                    self.hasty[half] = True
        # neighbours in some piece, packed: no merge ever crosses any other two characters
        self.joined = np.unique(np.array([ord(a) << 21 | ord(b) for p in self.ids for a, b in zip(p, p[1:])], dtype=np.int64))
        self.known: dict[str, bytes] = {}  # the ids of a word, 32 bits each
        self.shown: dict[str, bytes] = {}  # what they decode to
        self.cached = cached

    def symbol(self, p: str) -> int | None:
        return self.ids.get(p, self.size + ord(p) if len(p) == 1 else None)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of the pairs, filled and asked in vectorised probes."""
        self.bits = 20
        self.keys, self.merged = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, self.size, dtype=np.int64)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several, the last one stays
            placed = self.keys[at] == keys
            self.merged[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes; the vocabulary's size if none."""
        keys = left << 22 | right
        at = self._slot(keys)
        seen = self.keys[at]
        found = np.where(seen == keys, self.merged[at], self.size)
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            found[todo[hit]] = self.merged[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return found

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, flat, and each word's start.

        Words are first cut between characters that no piece has side by side. Each round finds the least pair rank of
        every part, merges that pair wherever it stands in the part (leftmost first where occurrences overlap; no further
        than the first that makes a better pair, see late), and closes the gaps. Parts without a pair left are set
        aside."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        chars, where = np.unique(flat, return_inverse=True)
        sym = np.array([self.symbol(chr(c)) for c in chars.tolist()], dtype=np.int64)[where]
        cut = np.zeros(len(flat), dtype=bool)
        firsts = np.cumsum(lengths) - lengths
        if len(flat):
            side = flat[:-1] << 21 | flat[1:]
            cut[1:] = self.joined[np.minimum(np.searchsorted(self.joined, side), len(self.joined) - 1)] != side
            cut[firsts[lengths > 0]] = True
        before = np.append(0, np.cumsum(cut))  # parts that start before a character
        word = before[1:] - 1
        parts = np.append(before[firsts], before[-1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            piece = self._merges(sym[:-1], sym[1:])
            piece[word[:-1] != word[1:]] = self.size
            piece = np.append(piece, self.size)
            rank = self.rank[piece]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            active = np.repeat(least < FAR, counts)
            hit = (rank == np.repeat(least, counts)) & active
            at = np.flatnonzero(hit)
            if not len(at):
                done.append((word, sym))
                break
            # runs of overlapping occurrences: every other one, from the left
            new_run = np.append(True, np.diff(at) != 1)
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            if self.hasty[piece[at]].any():
                at = at[~self.late(sym, word, piece, at)]
            sym[at] = piece[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            if not active.all():
                done.append((word[~active], sym[~active]))
                keep &= active
            sym, word = sym[keep], word[keep]
        word, sym = (np.concatenate(x) for x in zip(*done)) if done else (word, sym)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], parts)

    def late(self, sym: np.ndarray, word: np.ndarray, piece: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the merges at these places (ascending) come after one, in the same word, that makes a better pair
        with a neighbour: on its left what the merges before it leave, on its right a symbol not yet merged."""
        made = piece[at]
        left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
        beside = np.append(False, np.diff(at) == 2)
        on_left = self._merges(np.where(beside, made, sym[left]), made)
        on_right = self._merges(made, sym[right])
        better = (self.rank[on_left] < self.rank[made]) & (at > 0) & (word[left] == word[at])
        better |= (self.rank[on_right] < self.rank[made]) & (at + 2 < len(sym)) & (word[right] == word[at])
        so_far = np.cumsum(better) - better
        first = np.maximum.accumulate(np.where(np.append(True, word[at[1:]] != word[at[:-1]]), np.arange(len(at)), 0))
        return so_far > so_far[first]

    def encode_words(self, words: list[str]) -> Iterator[list[int]]:
        sym, starts = self.merge(words)
        listed, starts = sym.tolist(), starts.tolist()
        odd = np.add.reduceat(np.append(sym >= self.size, False), starts[:-1]).tolist() if words else []
        for a, b, unknown in zip(starts, starts[1:], odd):
            ids = listed[a:b]
            if unknown:
                ids = [i for s in ids for i in ([s] if s < self.size else [self.byte_ids[x] for x in chr(s - self.size).encode("utf-8", "surrogatepass")])]
            yield ids

    def words(self, text: str) -> list[str]:
        return self.WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            for w, ids in zip(some, self.encode_words(some), strict=True):
                self.known[w] = b"".join([self.raw[i] for i in ids])
                self.shown[w] = b"".join([self.text[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_words(self.words(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.text[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")

    def coded(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Of each text: its ids (little-endian, 32 bits each), and what they decode to."""
        some = [self.words(t) for t in texts]
        if len(self.known) > self.cached:
            self.known, self.shown = {}, {}
        self.learn(list(set().union(*some).difference(self.known)))
        known, shown = self.known.__getitem__, self.shown.__getitem__
        return [b"".join(map(known, w)) for w in some], [b"".join(map(shown, w)).removeprefix(b" ") for w in some]


def coder(model_file: str) -> PieceCoder:
    return common.kept_in_worker(("pieces", model_file), lambda: PieceCoder(model_file))


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (what decoding the ids gives) for every row of docs (doc_id, text).

    Null and empty texts have no ids. Texts of any length are encoded whole, words that a worker has met before from
    its cache. Repeated rows are rows of their own; ties don't arise; other columns of docs aren't read, whatever their
    names. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 100, keeps=True):
            raw, shown = coder(model_file).coded(part.column(1).to_pylist())
            flat = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
            starts = pa.array(np.cumsum([0, *(len(r) // 4 for r in raw)]), pa.int32())
            decoded = pa.array(shown, pa.binary()).cast(pa.string())
            out = [part.column(0), pa.ListArray.from_arrays(starts, flat), decoded]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, CODED)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with digests of their ids and decoded texts, by encoded: see there for nulls, empty and long texts,
    ties, repeated rows, empty tables and other columns."""
    import public_tokenizers

    rows = encoded(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
