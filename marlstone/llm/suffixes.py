"""Suffix-array dedup of repeated passages: bucket by bucket, long ties settled by difference-cover sample ranks.

A string of `length` bytes has a key, the least hash of its 25-byte grams, so equal strings have equal keys, and
neighbouring strings mostly share one. All suffixes of one key are a bucket. Three passes over groups of texts (the
same exchange each time) find which keys occur in two texts, hand the stretches of such keys to their buckets, and
apply the answers:

1. each group lists its distinct keys; buckets answer with two bits for each: in another text as well or not, and
   hot or not. A hot key has very many different stretches; in the later passes each of its strings has a key of its
   own, the string's hash, so that equal strings still meet and no bucket gets all of them;
2. each group hands over the distinct stretches (what neighbouring strings of one key cover) of repeated keys, with
   the least doc_id of each; a bucket sorts the suffixes of keys with several stretches, and answers with the least
   doc_id of each string;
3. each group removes what strings of smaller doc_ids cover.

Equal texts are one text of the least doc_id before all this, so a group of copies costs one of them in each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 50, 25
GRAMS = LENGTH - GRAM + 1
MIX = np.uint64(0x9E3779B97F4A7C15)
NONE = 2**63 - 1  # a null doc_id: larger than all
LONGEST = 512  # strings in one stretch
PIECE = 1 << 15
#: Fixed: a perfect difference cover. Any two residues have a shift below 13 that brings both into it.
PERIOD, COVER = 13, (0, 1, 3, 9)
SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
DEPTH = 56


# --- one block of suffixes ------------------------------------------------------------------------------------------


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number that sorts as they do; text must have 7 bytes to spare."""
    out = np.zeros(len(text) - 7, dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[k : len(out) + k]
    return out


def dense(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 0 of rows of columns (the first weighs most), equal for equal rows."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def sorted_suffixes(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given suffixes of data in order, and for each whether its first 50 bytes are its predecessor's.

    Suffixes are sorted by 16 bytes. Those that tie are compared by the ranks of cover samples (of 56 bytes each): for
    two residues there is one shift at which both are samples, so a suffix's place is the sum, over residues, of how
    many there rank before it."""
    text = np.frombuffer(data + bytes(DEPTH + 2 * PERIOD + 8), dtype=np.uint8)
    word = words_at(text)
    first = dense(word[starts], word[starts + 8])
    counts = np.bincount(first, minlength=1)
    tied = np.flatnonzero(counts[first] > 1)
    second = np.zeros(len(starts), dtype=np.int64)
    if len(tied):
        at = starts[tied]
        place = np.arange(len(data) + PERIOD + 1)
        sample = place[np.isin(place % PERIOD, COVER)]
        rank = np.zeros(len(place) + 1, dtype=np.int64)
        rank[sample] = dense(*(word[sample + 8 * k] for k in range(DEPTH // 8)))
        big, residue = int(rank.max()) + 1, at % PERIOD
        members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
        for b in range(PERIOD):
            if not len(members[b]):
                continue
            keys = {d: np.sort(first[tied[members[b]]] * big + rank[at[members[b]] + d]) for d in set(SHIFT[:, b].tolist())}
            for a in range(PERIOD):
                if len(members[a]):
                    d = int(SHIFT[a, b])
                    second[tied[members[a]]] += np.searchsorted(keys[d], first[tied[members[a]]] * big + rank[at[members[a]] + d])
    order = np.lexsort((second, first))
    p, q = starts[order[:-1]], starts[order[1:]]
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        same &= word[p + k] == word[q + k]
    return order, np.append(False, same)[: len(order)]


def least_docs(stretches: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each stretch, the least doc of all in which each of its strings occurs."""
    sizes = np.array([len(s) for s in stretches])
    n = sizes - LENGTH + 1
    ends = np.cumsum(n)
    starts = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(np.cumsum(sizes) - sizes, n)
    doc = np.repeat(docs, n)
    order, same = sorted_suffixes(b"".join(stretches), starts)
    heads = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(doc[order], heads), np.diff(np.append(heads, len(order))))
    out = np.empty(len(doc), dtype=np.int64)
    out[order] = least
    return np.split(out, ends[:-1])


# --- one group of texts ---------------------------------------------------------------------------------------------


def least_gram(byte: np.ndarray) -> np.ndarray:
    """For each string of 50 bytes the least hash of its grams of 25 bytes."""
    with np.errstate(over="ignore"):
        h = (byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        power, n = np.uint64(0x9E3779B97F4A7C15), 1
        while 2 * n <= GRAM:  # hashes of 2, 4, 8, 16 bytes
            h = h[:-n] * power + h[n:]
            power, n = power * power, 2 * n
        # two overlapping hashes of 16 bytes cover a gram
        least = h[: len(h) - (GRAM - n)] * np.uint64(0xFF51AFD7ED558CCD) + h[GRAM - n :]
        least ^= least >> np.uint64(29)
        least *= np.uint64(0xBF58476D1CE4E5B9)
        least ^= least >> np.uint64(32)
    span, n = LENGTH - GRAM + 1, 1
    while 2 * n <= span:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    return np.minimum(least[: len(least) - (span - n)], least[span - n :])


class Part(NamedTuple):
    """Stretches: where they start, of how many strings, under which key, and whose (number of the text)."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    owner: np.ndarray


class Group:
    """Texts of one group with the key of each of their strings, and the stretches of equal keys."""

    def __init__(self, rows: pd.DataFrame):
        least = rows["doc_id"].groupby(rows["digest"]).min()
        with_text = rows[rows["body"].notna()].drop_duplicates("digest").sort_values("digest")
        self.digest = with_text["digest"].tolist()
        self.doc = least[self.digest].to_numpy(dtype=np.int64) if self.digest else np.zeros(0, dtype=np.int64)
        bodies = with_text["body"].tolist()
        self.sizes = np.array([len(b) for b in bodies], dtype=np.int64)
        self.data = b"".join(bodies)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self._keys()

    def _keys(self) -> None:
        empty = np.zeros(0, dtype=np.int64)
        self.start, self.count, self.key, self.owner = empty, empty, empty.view(np.uint64), empty
        if len(self.data) < LENGTH:
            return
        byte = np.frombuffer(self.data, dtype=np.uint8)
        # in pieces whose arrays stay in the processor's cache
        least = np.concatenate([least_gram(byte[a : a + PIECE + LENGTH - 1]) for a in range(0, len(byte) - LENGTH + 1, PIECE)])
        # a doc's last 49 places start no string
        inside = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.add.at(inside, self.begin, 1)
        np.add.at(inside, np.maximum(self.begin, self.begin + self.sizes - LENGTH + 1), -1)
        inside = np.cumsum(inside)[: len(least)] > 0
        new = np.zeros(len(least), dtype=bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        new[self.begin[self.begin < len(least)]] = True
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(least)))
        keep = inside[start]
        start, count = start[keep], count[keep]
        pieces = -(-count // LONGEST)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = np.repeat(start, pieces) + part * LONGEST
        self.count = np.minimum(np.repeat(count, pieces) - part * LONGEST, LONGEST)
        self.key = least[self.start]
        self.owner = np.searchsorted(self.begin, self.start, side="right") - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys in order, whether two texts here have it, and about how many different stretches it has."""
        order = np.argsort(self.key, kind="stable")
        key, owner = self.key[order], self.owner[order]
        if not len(key):
            return key, np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(heads, len(key)))
        several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
        # stretches of a key that occurs more than once are told apart by their lengths and 16 bytes at their ends
        which = np.repeat(np.arange(len(heads), dtype=np.int32), times)
        again = np.repeat(times > 1, times)
        which, at, count = which[again], self.start[order[again]], self.count[order[again]]
        sign = (self._word(at) * MIX ^ self._word(at + count + (LENGTH - 9))) * MIX + count.astype(np.uint64)
        del at, count, order, again
        place = np.lexsort((sign, which))
        which, sign = which[place], sign[place]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (which[1:] != which[:-1]) | (sign[1:] != sign[:-1])
        kinds = np.maximum(np.bincount(which[new], minlength=len(heads)), 1)
        return key[heads], several, kinds

    def _word(self, at: np.ndarray) -> np.ndarray:
        """The 8 bytes at each place as one number, made in pieces that stay small."""
        byte, out = np.frombuffer(self.data, dtype=np.uint8), np.zeros(len(at), dtype=np.uint64)
        for a in range(0, len(at), PIECE):
            out[a : a + PIECE] = byte[at[a : a + PIECE, None] + np.arange(8)].view(np.uint64).ravel()
        return out

    def _string_key(self, at: np.ndarray) -> np.ndarray:
        """A key for each string of 50 bytes, from its hash, distributed as least hashes are (see bucket_of)."""
        out = np.zeros(len(at), dtype=np.uint64)
        for a in range(0, len(at), 1 << 18):
            h = np.zeros(len(at[a : a + (1 << 18)]), dtype=np.uint64)
            for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
                h = (h ^ self._word(at[a : a + (1 << 18)] + k)) * MIX
                h ^= h >> np.uint64(29)
            share = h.astype(np.float64) / 2.0**64
            out[a : a + (1 << 18)] = (-np.expm1(np.log1p(-np.minimum(share, 1 - 1e-15)) / GRAMS) * 2.0**64).astype(np.uint64)
        return out

    def repeated(self, answers: pd.DataFrame, buckets: int) -> Part:
        """The stretches whose keys another text has, those of hot keys string by string: from the buckets' bits, which
        are in the order of distinct()."""
        keys = np.unique(self.key)
        if not len(keys):
            return Part(self.start, self.count, self.key, self.owner)
        found, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
        own, asked = bucket_of(keys, buckets), answers["bucket"].to_numpy()
        starts, ends = np.searchsorted(own, asked), np.searchsorted(own, asked, side="right")
        for a, b, data in zip(starts.tolist(), ends.tolist(), answers["data"]):
            bits = np.frombuffer(data, dtype=np.uint8).reshape(2, -1)
            found[a:b] = np.unpackbits(bits[0], count=b - a).astype(bool)
            hot[a:b] = np.unpackbits(bits[1], count=b - a).astype(bool)
        at = np.searchsorted(keys, self.key)
        which, single = np.flatnonzero(found[at] & ~hot[at]), np.flatnonzero(hot[at])
        n = self.count[single]
        start = np.repeat(self.start[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return Part(
            np.append(self.start[which], start),
            np.append(self.count[which], np.ones(len(start), dtype=np.int64)),
            np.append(self.key[which], self._string_key(start)),
            np.append(self.owner[which], np.repeat(self.owner[single], n)),
        )

    def stretches(self, part: Part) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """Distinct stretches, numbered by first occurrence; the number of each of part; the least doc of each."""
        seen: dict[bytes, int] = {}
        data, ends = self.data, part.start + part.count + (LENGTH - 1)
        number = [seen.setdefault(data[a:b], len(seen)) for a, b in zip(part.start.tolist(), ends.tolist())]
        number = np.array(number, dtype=np.int64)
        least = np.full(len(seen), NONE, dtype=np.int64)
        np.minimum.at(least, number, self.doc[part.owner])
        return seen, number, least


def dealt(part: Part, number: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The key of each of n stretches, and for each bucket that has some its stretches' numbers."""
    key = np.zeros(n, dtype=np.uint64)
    key[number] = part.key
    bucket = bucket_of(key, buckets)
    order = np.argsort(bucket, kind="stable")
    names, heads = np.unique(bucket[order], return_index=True)
    return key, list(zip(names.tolist(), np.split(order, heads[1:]))) if n else []


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys. Keys are least hashes, so small ones are common; the power evens the ranges out."""
    share = key.astype(np.float64) / 2.0**64
    return np.minimum((buckets * -np.expm1(GRAMS * np.log1p(-np.minimum(share, 1 - 1e-16)))).astype(np.int64), buckets - 1)


def removed(group: Group, part: Part, number: np.ndarray, least: list[np.ndarray]) -> list[tuple]:
    """(digest, first_id, spans, kept_sha256) of each text; spans: starts and ends of what goes, one after the other."""
    cover = np.zeros(len(group.data) + 1, dtype=np.int32)
    if len(number):
        count = part.count
        flat = np.concatenate([least[i] for i in number])
        place = np.repeat(part.start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gone = place[flat < np.repeat(group.doc[part.owner], count)]
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + LENGTH, -1)
    hidden = np.cumsum(cover)[:-1] > 0
    byte, rows = np.frombuffer(group.data, dtype=np.uint8), []
    for digest, doc, a, n in zip(group.digest, group.doc.tolist(), group.begin.tolist(), group.sizes.tolist()):
        h = hidden[a : a + n]
        spans, sha = None, digest
        if h.any():
            spans = np.flatnonzero(np.diff(h, prepend=False, append=False)).tolist()
            sha = hashlib.sha256(byte[a : a + n][~h].tobytes()).hexdigest()
        rows.append((digest, None if doc == NONE else doc, spans, sha))
    return rows


# --- on Spark -------------------------------------------------------------------------------------------------------


def texts(df: DataFrame, groups: int) -> DataFrame:
    """g, digest, doc_id, body: each task's distinct texts once, with the doc_id it saw first; smaller ones without body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict[str, int] = {}
        for batch in batches:
            rows = []
            for own, body in zip(batch["doc_id"].tolist(), batch["body"]):
                digest = hashlib.sha256(body).hexdigest()
                if digest not in least or own < least[digest]:
                    rows.append((int(digest[:12], 16) % groups, digest, own, None if digest in least else bytes(body)))
                    least[digest] = own
            yield pd.DataFrame(rows, columns=["g", "digest", "doc_id", "body"]).astype({"g": "int64", "doc_id": "int64"})

    rows = df.select(
        F.coalesce("doc_id", F.lit(NONE)).alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("body"),
    )
    return rows.mapInPandas(run, "g long, digest string, doc_id long, body binary")


def without_repeats(df: DataFrame, group_bytes: int = 5_000_000, hot: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end of each maximal removed run, in bytes) and kept_sha256 (of the
    remaining bytes) for every row.

    A byte goes if a 50-byte string that covers it also starts in a document of smaller doc_id. Null texts count as
    empty, and texts of under 50 bytes stay whole; a text of any length is one group's at least, in memory. A null doc_id
    is larger than all others; rows of one doc_id (ties, repeated rows) don't remove each other's strings. Other columns
    of df aren't read, whatever their names. An empty table gives no rows.

    hot: keys with over so many different stretches, counted by group, are dealt string by string."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    narrow = df.select("doc_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    narrow = common.saved(narrow)
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    buckets = min(groups, max(256, groups // 4))
    grouped = texts(df, groups).groupBy("g")

    def list_keys(rows: pd.DataFrame) -> pd.DataFrame:
        group = Group(rows)
        keys, several, kinds = group.distinct()
        # six bytes of a key tell it apart well enough here: answers only choose what is compared
        low = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 2:]
        facts = np.minimum(kinds, 127).astype(np.uint8) | (several.astype(np.uint8) << 7)
        names, heads = np.unique(bucket_of(keys, buckets), return_index=True)
        g, ends, out = int(rows["g"].iloc[0]), [*heads[1:], len(keys)], []
        for b, i, j in zip(names.tolist(), heads.tolist(), ends):
            out.append((b, g, np.ascontiguousarray(low[i:j].T).tobytes(), facts[i:j].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "g", "keys", "facts"])

    def answer_keys(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g")
        parts = []
        for data in rows["keys"]:
            n = len(data) // 6
            wide = np.zeros((n, 8), dtype=np.uint8)
            wide[:, 2:] = np.frombuffer(data, dtype=np.uint8).reshape(6, n).T
            parts.append(wide.view("<u8").ravel())
        key, facts = np.concatenate(parts), np.frombuffer(b"".join(rows["facts"]), dtype=np.uint8)
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        times = np.diff(np.append(heads, len(order)))
        several = np.maximum.reduceat(facts[order] >> 7, heads).astype(bool) | (times > 1)
        many = np.add.reduceat((facts[order] & 127).astype(np.int64), heads) > hot
        twice, often = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
        twice[order], often[order] = np.repeat(several, times), np.repeat(several & many, times)
        edges = np.cumsum([0, *map(len, parts)])
        bits = [np.packbits(twice[a:b]).tobytes() + np.packbits(often[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
        return pd.DataFrame({"g": rows["g"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "data": bits})

    listed = grouped.applyInPandas(list_keys, "bucket long, g long, keys binary, facts binary")
    bits = listed.groupBy("bucket").applyInPandas(answer_keys, "g long, bucket long, data binary")

    def hand_over(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "g", "sizes", "docs", "keys", "data"]
        if not len(rows):
            return pd.DataFrame(columns=columns)
        group = Group(rows)
        part = group.repeated(answers, buckets)
        seen, number, least = group.stretches(part)
        key, by_bucket = dealt(part, number, len(seen), buckets)
        listed, g, out = list(seen), int(rows["g"].iloc[0]), []
        for b, own in by_bucket:
            some = [listed[i] for i in own]
            sizes = np.array([len(s) for s in some], dtype=np.uint16).tobytes()
            out.append((b, g, sizes, least[own].tobytes(), key[own].tobytes(), b"".join(some)))
        return pd.DataFrame(out, columns=columns)

    def sort_buckets(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g")
        number, seen, docs, keys = [], {}, [], []
        for sizes, doc, key, data in zip(rows["sizes"], rows["docs"], rows["keys"], rows["data"]):
            ends = np.cumsum(np.frombuffer(sizes, dtype=np.uint16).astype(np.int64)).tolist()
            number.append(np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip([0, *ends], ends)], dtype=np.int64))
            docs.append(np.frombuffer(doc, dtype=np.int64))
            keys.append(np.frombuffer(key, dtype=np.uint64))
        flat, listed = np.concatenate(number), list(seen)
        least, key = np.full(len(listed), NONE, dtype=np.int64), np.zeros(len(listed), dtype=np.uint64)
        np.minimum.at(least, flat, np.concatenate(docs))
        key[flat] = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        answer = [least[i : i + 1] for i in range(len(listed))]  # one value: for all strings of the stretch
        edges = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])).tolist()
        block: list[int] = []
        size = 0
        for a, b in zip(edges, [*edges[1:], len(order)]):
            if b - a > 1:
                own = order[a:b].tolist()
                block += own
                size += sum(len(listed[i]) for i in own)
            if block and (size >= 1_000_000 or b == len(order)):
                for i, x in zip(block, least_docs([listed[i] for i in block], least[block])):
                    answer[i] = x[:1] if (x == x[0]).all() else x
                block, size = [], 0
        out = []
        for g, bucket, own in zip(rows["g"], rows["bucket"], number):
            some = [answer[i] for i in own]
            out.append((g, bucket, np.array([len(x) for x in some], dtype=np.uint16).tobytes(), np.concatenate(some).tobytes()))
        return pd.DataFrame(out, columns=["g", "bucket", "sizes", "data"])

    handed = "bucket long, g long, sizes binary, docs binary, keys binary, data binary"
    strings = grouped.cogroup(bits.groupBy("g")).applyInPandas(hand_over, handed)
    least = strings.groupBy("bucket").applyInPandas(sort_buckets, "g long, bucket long, sizes binary, data binary")
    told = bits.select("g", "bucket", F.lit(None).cast("binary").alias("sizes"), "data").unionByName(least)

    def apply(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["digest", "first_id", "gone", "kept_sha256"]
        if not len(rows):
            return pd.DataFrame(columns=columns)
        group = Group(rows)
        first = answers["sizes"].isna()
        part = group.repeated(answers[first], buckets)
        seen, number, _ = group.stretches(part)
        by_bucket = dict(dealt(part, number, len(seen), buckets)[1])
        size = np.zeros(len(seen), dtype=np.int64)
        size[number] = part.count
        values: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(seen)
        for bucket, sizes, data in zip(answers["bucket"][~first], answers["sizes"][~first], answers["data"][~first]):
            ends = np.cumsum(np.frombuffer(sizes, dtype=np.uint16).astype(np.int64)).tolist()
            flat = np.frombuffer(data, dtype=np.int64)
            for i, a, b in zip(by_bucket[bucket].tolist(), [0, *ends], ends):
                values[i] = flat[a:b] if b - a == size[i] else np.broadcast_to(flat[a], size[i])
        return pd.DataFrame(removed(group, part, number, values), columns=columns).astype({"first_id": "Int64"})

    told = grouped.cogroup(told.groupBy("g"))
    result = told.applyInPandas(apply, "digest string, first_id long, gone array<long>, kept_sha256 string")
    own, long_enough = F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("n_bytes") >= LENGTH
    pick = lambda mine, copy, short: F.when(own, mine).otherwise(F.when(long_enough, copy).otherwise(short))
    # a copy of an earlier text goes as a whole
    gone = pick(F.col("gone"), F.array(F.lit(0).cast("long"), F.col("n_bytes")), F.lit(None).cast("array<long>"))
    gone = F.coalesce(gone, F.array().cast("array<long>"))
    evens = F.filter(gone, lambda _, i: i % 2 == 0)
    odds = F.filter(gone, lambda _, i: i % 2 == 1)
    spans = F.zip_with(evens, odds, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    kept = pick(F.col("kept_sha256"), F.sha2(F.lit("").cast("binary"), 256), F.col("digest"))
    return narrow.join(result, "digest").select("doc_id", "n_bytes", spans.alias("spans"), kept.alias("kept_sha256"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with counts of what goes, by without_repeats: see there for nulls, empty and long texts, ties, repeated
    rows, empty tables and other columns."""
    rows = without_repeats(common.documents(spark, sf_dir).select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
