"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs, trained and run in numpy."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"\w+")
GRAMS = (3, 4, 5)
PRIME, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
GRAM_BITS = 22
BLOCK = 4_000  # words whose n-grams are held at once


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (GRAM_BITS bits) of all character n-grams of ^word$, flat, and the word that each belongs to."""
    marked = ["^" + w + "$" for w in words]
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), dtype=np.int64, count=len(marked)))
    hashes, owners, h = [], [], np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(flat) < n:
            break
        h = (h[: len(flat) - n + 1] ^ flat[n - 1 :] + np.uint64(n)) * PRIME
        h ^= h >> np.uint64(31)
        if n in GRAMS:
            whole = owner[: len(h)] == owner[n - 1 :]
            hashes.append(h[whole])
            owners.append(owner[: len(h)][whole])
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)]) * MIX >> np.uint64(64 - GRAM_BITS)
    return flat.astype(np.int32), np.concatenate([*owners, np.zeros(0, np.int64)])


def log_odds(positive: np.ndarray, negative: np.ndarray, p: int, n: int) -> np.ndarray:
    """How many standard deviations the log odds of presence in documents of label 1 lie above those of label 0."""
    a, b = positive + 0.5, negative + 0.5
    c, d = p - positive + 0.5, n - negative + 0.5
    return (np.log(a / c) - np.log(b / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


@dataclass
class Model:
    """words and grams: rows of the embedding tables (row 0: any other). hidden: of each direction."""

    words: dict[str, int]
    grams: np.ndarray
    p: dict[str, np.ndarray]
    hidden: int = 8
    window: int = 64
    stride: int = 48
    cached: int = 80_000
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _inputs: np.ndarray | None = field(default=None, repr=False)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of words: the word's embedding and, per dimension, the largest value among its known n-grams; with
        the table rows that these came from."""
        parts = [self._features(words[at : at + BLOCK]) for at in range(0, max(len(words), 1), BLOCK)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.fromiter((self.words.get(w, 0) for w in words), dtype=np.int32, count=len(words))
        hashes, owner = gram_hashes(words)
        at = np.minimum(np.searchsorted(self.grams, hashes), max(len(self.grams) - 1, 0))
        known = self.grams[at] == hashes if len(self.grams) else np.zeros(len(hashes), dtype=bool)
        at, owner = at[known] + 1, owner[known]
        dims = self.p["G"].shape[1]
        best = np.zeros((len(words), dims), dtype=np.int32)
        if len(at):
            order = np.argsort(owner, kind="stable")
            at, owner = at[order], owner[order]
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            for k in range(dims):
                top = np.repeat(np.maximum.reduceat(self.p["G"][at, k], starts), np.diff(np.append(starts, len(at))))
                hit = self.p["G"][at, k] >= top
                best[owner[hit], k] = at[hit]
        chars = self.p["G"][best, np.arange(dims)] * (best > 0)
        return np.concatenate([self.p["E"][row], chars], axis=1).astype(np.float32), row, best

    def windows(self, n_tokens: int) -> list[int]:
        """Starts of the overlapping windows over all tokens; no tokens make one empty window."""
        return list(range(0, max(1, n_tokens - (self.window - self.stride)), self.stride))

    def _steps(self, x: np.ndarray, lengths: np.ndarray, u: np.ndarray, backward: bool, keep: list | None) -> np.ndarray:
        """One direction over projected inputs x (T, B, 3 hidden); hidden states (T, B, hidden)."""
        t_n, b_n, k = x.shape[0], x.shape[1], self.hidden
        h, out = np.zeros((b_n, k), dtype=np.float32), np.zeros((t_n, b_n, k), dtype=np.float32)
        full = int(lengths.min()) if b_n else 0
        for t in range(t_n - 1, -1, -1) if backward else range(t_n):
            g = h @ u
            zr = 1 / (1 + np.exp(-(x[t, :, : 2 * k] + g[:, : 2 * k])))
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(x[t, :, 2 * k :] + r * g[:, 2 * k :])
            new = n + z * (h - n)
            if t >= full:
                new = np.where((lengths > t)[:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * k :]))
            out[t] = h = new
        return out

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows whose projected inputs are x (T, B, 6 hidden)."""
        k = 3 * self.hidden
        kept = ([], []) if keep is not None else (None, None)
        forth = self._steps(x[:, :, :k], lengths, self.p["Uf"], False, kept[0])
        back = self._steps(x[:, :, k:], lengths, self.p["Ub"], True, kept[1])
        h = np.concatenate([forth, back], axis=2)
        a = np.tanh(h @ self.p["A"] + self.p["a"])
        e = a @ self.p["v"]
        e = np.where(np.arange(len(x))[:, None] < np.maximum(lengths, 1), e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        c = np.einsum("tb,tbk->bk", w, h)
        if keep is not None:
            keep.update(h=h, a=a, w=w, c=c, steps=kept)
        return c @ self.p["o"] + self.p["ob"][0]

    def backward(self, x_in: np.ndarray, lengths: np.ndarray, keep: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and of the inputs x_in (T, B, dims)."""
        p, k = self.p, self.hidden
        h, a, w, c = keep["h"], keep["a"], keep["w"], keep["c"]
        g = {"o": c.T @ d_logit, "ob": d_logit.sum(keepdims=True)}
        dc = d_logit[:, None] * p["o"]
        dh = w[:, :, None] * dc
        dw = np.einsum("bk,tbk->tb", dc, h)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tb,tba->a", de, a)
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["A"], g["a"] = np.einsum("tbk,tba->ka", h, da), da.sum(axis=(0, 1))
        dh += da @ p["A"].T
        dx = np.zeros((*h.shape[:2], 6 * k), dtype=np.float32)
        for side, name in enumerate(("Uf", "Ub")):
            du, carry = np.zeros_like(p[name]), np.zeros((h.shape[1], k), dtype=np.float32)
            for t, before, z, r, n, gn in reversed(keep["steps"][side]):
                live = (lengths > t)[:, None]
                d = dh[t, :, side * k : side * k + k] + carry
                dn = d * (1 - z) * (1 - n * n) * live
                dz = d * (before - n) * z * (1 - z) * live
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ dg
                dx[t, :, side * 3 * k : side * 3 * k + 3 * k] = np.concatenate([dz, dr, dn], axis=1)
                carry = np.where(live, d * z, d) + dg @ p[name].T
            g[name] = du
        g["W"], g["b"] = np.einsum("tbd,tbk->dk", x_in, dx), dx.sum(axis=(0, 1))
        return g, dx @ p["W"].T

    def scores(self, texts: list[str], tokens_at_once: int = 60_000) -> np.ndarray:
        """The largest window's probability for each whole text."""
        out, group, size = np.zeros(len(texts)), [], 0
        for i, text in enumerate(texts):
            tokens = TOKEN.findall(text.lower())
            group.append((i, tokens))
            size += len(tokens)
            if size >= tokens_at_once or i + 1 == len(texts):
                self._score(group, out)
                group, size = [], 0
        return out

    def _score(self, group: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        known = self._rows
        new = list(set().union(*(tokens for _, tokens in group)).difference(known))
        if not known or len(known) + len(new) > len(self._inputs):
            known = self._rows = {"": 0}
            new = ["", *set().union(*(tokens for _, tokens in group))]
            self._inputs = np.zeros((max(self.cached, len(new)), 6 * self.hidden), dtype=np.float32)
            known.clear()
        if new:
            at = len(known)
            known.update(zip(new, range(at, at + len(new))))
            self._inputs[at : at + len(new)] = self.features(new)[0] @ self.p["W"] + self.p["b"]
        table = self._inputs
        flat = np.array([known[t] for _, tokens in group for t in tokens] + [0] * self.window, dtype=np.int32)
        starts, lengths, owner, base = [], [], [], 0
        for i, tokens in group:
            for s in self.windows(len(tokens)):
                starts.append(base + s)
                lengths.append(min(self.window, len(tokens) - s))
                owner.append(i)
            base += len(tokens)
        starts, lengths, owner = np.array(starts), np.array(lengths), np.array(owner)
        logits = np.zeros(len(starts))
        for at in range(0, len(starts), 512):
            part = slice(at, at + 512)
            n = max(1, int(lengths[part].max()))
            idx = flat[starts[part][None, :] + np.arange(n)[:, None]]
            idx[np.arange(n)[:, None] >= lengths[part]] = 0
            logits[part] = self.forward(table[idx], lengths[part])
        np.maximum.at(out, owner, 1 / (1 + np.exp(-logits)))


def train(texts: Iterable[str], labels: list[int], steps: int = 240, batch: int = 48, rows: int = 4096, seed: int = 3) -> Model:
    """Embedding rows are the words and n-grams whose presence tells the labels apart (4 documents and 2.5 standard
    deviations at least); the first dimension starts as that statistic, all else at random, and all is learnt.

    A document's label is its likeliest window's: every so often all windows are scored, and each document trains
    the window that is on top. Adam, cross entropy, a third of a batch with label 1.

    Texts are read once, one by one, and only their words' numbers are kept; labels are looked at after that."""
    r = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    number = lambda t: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in TOKEN.findall(t.lower())], dtype=np.int32)
    ids = [number(t) for t in texts]
    y = np.array(labels, dtype=np.int64)
    names = list(vocabulary)
    vocabulary.clear()
    grams, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(names), BLOCK):
        some = names[at : at + BLOCK]
        hashes, owner = gram_hashes(some)
        grams.append(hashes[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner, minlength=len(some)))
    grams, edges = np.concatenate(grams), np.cumsum(np.append(0, np.concatenate(sizes)))
    word_df, gram_df = np.zeros((2, len(names)), np.float32), np.zeros((2, 1 << GRAM_BITS), np.float32)
    for d, label in zip(ids, y):
        u = np.unique(d)
        word_df[label, u] += 1
        if len(u):
            gram_df[label, np.unique(np.concatenate([grams[edges[w] : edges[w + 1]] for w in u]))] += 1
    p_n, n_n = int((y == 1).sum()), int((y == 0).sum())

    def chosen(df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.flatnonzero(df.sum(axis=0) >= 4)
        z = log_odds(df[1, keep].astype(np.float64), df[0, keep].astype(np.float64), p_n, n_n)
        keep, z = keep[np.abs(z) >= 2.5], z[np.abs(z) >= 2.5]
        order = np.sort(np.argsort(-np.abs(z), kind="stable")[:rows])
        return keep[order], np.clip(z[order] / 4, -1.5, 2).astype(np.float32)

    (w_keep, w_z), (g_keep, g_z) = chosen(word_df), chosen(gram_df)
    del grams, edges, word_df, gram_df
    h, dw, dg, att = 8, 4, 6, 8
    small = lambda *shape, s=0.3: (r.standard_normal(shape) * s).astype(np.float32)
    e, g = small(len(w_keep) + 1, dw, s=0.05), small(len(g_keep) + 1, dg, s=0.05)
    e[0] = g[0] = 0
    e[1:, 0], g[1:, 0] = w_z, g_z
    p = {"E": e, "G": g, "W": small(dw + dg, 6 * h), "b": np.zeros(6 * h, np.float32)}
    p |= {"Uf": small(h, 3 * h), "Ub": small(h, 3 * h)}
    p |= {"A": small(2 * h, att), "a": np.zeros(att, np.float32), "v": small(att, s=1.0)}
    p |= {"o": small(2 * h, s=0.5), "ob": np.array([-1.0], np.float32)}
    model = Model({names[i]: k + 1 for k, i in enumerate(w_keep)}, g_keep.astype(np.int32), p)
    if not p_n or not n_n:
        p["o"][:] = 0
        p["ob"][0] = 4.0 if p_n else -4.0
        return model
    at = [(i, s) for i, d in enumerate(ids) for s in model.windows(len(d))]
    owner, start = np.array([i for i, _ in at]), np.array([s for _, s in at])
    lengths = np.array([min(model.window, len(ids[i]) - s) for i, s in at])
    padded = [np.append(d, np.full(model.window, len(names), np.int32)) for d in ids]
    x_all, e_row, g_row = model.features([*names, ""])

    def of(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = max(1, int(lengths[windows].max()))
        idx = np.stack([padded[owner[w]][start[w] : start[w] + n] for w in windows], axis=1)
        return idx, lengths[windows]

    def tops(score: np.ndarray) -> np.ndarray:
        order = np.lexsort((score, owner))
        return order[np.append(owner[order][1:] != owner[order][:-1], True)]

    hint = np.maximum(x_all[:, 0], 0) + np.maximum(x_all[:, dw], 0)
    top = tops(np.array([float(hint[padded[i][s : s + n]].sum()) for (i, s), n in zip(at, lengths)]))
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for step in range(1, steps + 1):
        if step % 75 == 0:
            x_all, e_row, g_row = model.features([*names, ""])
            score = np.zeros(len(at))
            for a in range(0, len(at), 1024):
                idx, n = of(np.arange(a, min(len(at), a + 1024)))
                score[a : a + 1024] = model.forward(x_all[idx] @ p["W"] + p["b"], n)
            top = tops(score)
        own = np.concatenate([r.choice(positive, batch // 3), r.choice(negative, batch - batch // 3)])
        idx, n = of(top[own])
        flat = np.unique(idx)
        # the inputs of these words only, from the tables as they are now
        e_now, g_now = p["E"][e_row[flat]], p["G"][g_row[flat], np.arange(dg)] * (g_row[flat] > 0)
        x_all[flat] = np.concatenate([e_now, g_now], axis=1)
        x, keep = x_all[idx], {}
        logit = model.forward(x @ p["W"] + p["b"], n, keep)
        prob = 1 / (1 + np.exp(-logit))
        grads, dx = model.backward(x, n, keep, ((prob - y[own]) / batch).astype(np.float32))
        dx = dx.reshape(-1, dw + dg)
        rows_e, rows_g = e_row[idx.ravel()], g_row[idx.ravel()]
        grads["E"], grads["G"] = np.zeros_like(p["E"]), np.zeros_like(p["G"])
        np.add.at(grads["E"], rows_e, dx[:, :dw])
        for k in range(dg):
            np.add.at(grads["G"][:, k], rows_g[:, k], dx[:, dw + k])
        grads["E"][0] = grads["G"][0] = 0
        for k, d in grads.items():
            d = d + 1e-4 * p[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            pace = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            p[k] -= ((0.01 if k not in "EG" else 0.003) * pace).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(spark: SparkSession, sf_dir: str, sample: int = 2500, longest: int = 1_000_000, sample_bytes: int = 64_000_000) -> Model:
    """Trains on at most sample labelled documents that aren't held out: those of least hash of doc_id, without texts of
    over longest bytes, and no more than sample_bytes in all. Texts and labels only.

    One document a doc_id counts (the text of least hash), so an id that repeats over many rows is one row here. Labels
    that are null, or whose document is missing, don't count; of several labels of an id, the greatest. One task trains,
    and the driver gets its model: two tables of at most 4097 rows and a few matrices."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic in (0, 1) and doc_id is not null")
    some = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = common.documents(spark, sf_dir).select("doc_id", "text").where(F.octet_length("text") <= longest)
    # at most sample rows of two numbers are broadcast
    one = (
        docs
        .join(F.broadcast(some), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = []

        def texts() -> Iterator[str]:
            size = 0
            for batch in common.slices(batches, 100):
                for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    size += len(text)
                    if size <= sample_bytes:
                        marks.append(mark)
                        yield text

        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts(), marks))], pa.binary())], ["model"])
        common.trim()

    rows = one.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "toxic")
    found = rows.mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else train([], [])


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs, text too, and score (double); a column of docs that is named score is replaced.

    Every row gets a score, and repeated rows and ties the same one. Null and empty texts are one window without words.
    Texts of any length are scored by all their windows. An empty table gives no rows."""
    kept = [c for c in docs.columns if c.lower() != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = common.unused(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 1000):
            scores = pa.array(shared.value.scores(part.column(len(kept)).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], scores], [*kept, "score"])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(own))
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a score by score_documents (see there for nulls, empty and long texts, ties, repeated rows,
    empty tables and other columns). A null doc_id isn't held out."""
    scored = score_documents(common.documents(spark, sf_dir).select("doc_id", "text"), fit(spark, sf_dir))
    outside = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored.select("doc_id", outside, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
