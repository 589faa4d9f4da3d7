"""Operator 7, toxicity: bags of subword embeddings averaged into a linear softmax, trained in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, all in
hashed rows of one matrix; a stretch of words is the mean of its words; a linear softmax reads it.
The matrix and the softmax are trained together. A misspelling never seen shares most of its n-grams
with the word it comes from, and so its vector.

A text is scored by its strongest stretch of STRETCH words, so a long text cannot hide an insult
among thousands of clean words. Labels belong to texts, so after the first epochs a toxic text
teaches with the stretches that the model finds toxic in it, its strongest one at least.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.shipping import ship

from .common import read, release, trim

#: Bounds of the sample that the model is fitted on: rows and bytes of text of each label.
TOXIC_ROWS, CLEAN_ROWS, TOXIC_BYTES, CLEAN_BYTES = 2500, 6000, 6_000_000, 15_000_000
STRETCH, GRAMS, BUCKETS, WIDTH, EPOCHS, STEPS, BATCH, RATE, SEED = 32, (3, 4, 5), 1 << 18, 8, 6, 4000, 256, 0.3, 7
THRESHOLD, KEPT_WORDS, RUN_CHARS = 0.3, 250_000, 1_000_000

_runs = re.compile(r"[^\W_]+").findall


def find(text: str) -> list[str]:
    """Runs of letters and digits that are not digits alone: a digit in place of a letter does not part a word."""
    return [w for w in _runs(text) if not w.isdigit()]


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the matrix for each word, one after another, and how many each word has. Some thousand words at a time, to bound what stands in memory."""
    parts = [_buckets(words[i : i + 8192]) for i in range(0, len(words), 8192)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    end = np.repeat(np.cumsum(size), size)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(chars))
    rows = [np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.int64, count=len(words)) % BUCKETS]
    owners = [np.arange(len(words))]
    mix = np.uint64(0x9E3779B97F4A7C15)
    for n in GRAMS:
        at = np.flatnonzero(place + n <= end)
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ chars[at + k]) * mix
            h ^= h >> np.uint64(31)
        rows.append((h % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(word[at])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order].astype(np.int32), np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    """What is left of the trained layers: what a row of the matrix adds to the log-odds, and the bias."""

    odds: np.ndarray
    bias: float

    def of_words(self, words: list[str]) -> np.ndarray:
        rows, count = buckets(words)
        return np.add.reduceat(self.odds[rows], np.cumsum(count) - count) / count

    def scores(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        out, at = [np.empty(0)], 0
        while at < len(texts):  # the words of a bounded run of texts at a time
            begin, held = at, 0
            while at < len(texts) and held < RUN_CHARS:
                held += len(texts[at])
                at += 1
            out.append(self._scores(texts[begin:at], known))
        return np.concatenate(out)

    def _scores(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        split = [find(t.lower()) for t in texts]
        if len(known) > KEPT_WORDS:
            known.clear()
        if new := list({w for ws in split for w in ws if w not in known}):
            known.update(zip(new, self.of_words(new).tolist(), strict=True))
        get = known.__getitem__
        out = np.empty(len(texts))
        for i, ws in enumerate(split):
            z = self.bias
            if ws:
                v = np.fromiter(map(get, ws), dtype=np.float64, count=len(ws))
                cuts = np.arange(0, max(1, len(v) - STRETCH // 2), STRETCH)  # a rest under half a stretch joins the last one
                z += (np.add.reduceat(v, cuts) / np.diff(cuts, append=len(v))).max()
            out[i] = z
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def calibrated(model: Model, texts: list[str], labels: list[int]) -> Model:
    """Move the bias so that THRESHOLD divides these texts, which taught nothing, as well as can be: amid the cuts of the best F1."""
    y, p = np.array(labels), np.clip(model.scores(texts, {}), 1e-12, 1 - 1e-12)
    if len(set(labels)) < 2:
        return model
    z = np.log(p / (1 - p))
    cuts = np.unique(z)
    cuts = (cuts[1:] + cuts[:-1]) / 2
    f1 = np.array([2 * (y[z > c] == 1).sum() / ((z > c).sum() + (y == 1).sum()) for c in cuts])
    if not len(cuts):
        return model
    best = cuts[f1 >= f1.max() - 1e-9]
    return Model(model.odds, model.bias + float(np.log(THRESHOLD / (1 - THRESHOLD)) - (best.min() + best.max()) / 2))


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """Train on four fifths of whole texts and calibrate on the others; None if one of the labels is missing."""
    model = train([t for i, t in enumerate(texts) if i % 5], [y for i, y in enumerate(labels) if i % 5]) or train(texts, labels)
    return model and calibrated(model, texts[::5], labels[::5])


def gradients(table: np.ndarray, soft: np.ndarray, bias: np.ndarray, token: np.ndarray, n: np.ndarray, of: tuple, label: np.ndarray, weight: np.ndarray) -> tuple:
    """Of the weighted mean cross-entropy of stretches: token, the words of all stretches one after another, n of each; of, the rows of
    every word, how many and where they begin. Returns the rows touched, their gradient, and those of the softmax and its bias."""
    rows, count, first = of
    words, place = np.unique(token, return_inverse=True)
    m = count[words]
    own = np.repeat(np.arange(len(words)), m)
    row = rows[np.repeat(first[words] - (np.cumsum(m) - m), m) + np.arange(len(own))]
    vectors = np.add.reduceat(table[row], np.cumsum(m) - m) / m[:, None]
    mean = np.add.reduceat(vectors[place], np.cumsum(n) - n) / n[:, None]
    z = mean @ soft + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(n)), label] -= 1
    p *= weight[:, None] / len(n)
    down, stretch = p @ soft.T / n[:, None], np.repeat(np.arange(len(n)), n)
    to_word = np.stack([np.bincount(place, down[stretch, d], len(words)) for d in range(soft.shape[0])], axis=1) / m[:, None]
    touched, spot = np.unique(row, return_inverse=True)
    grad = np.stack([np.bincount(spot, to_word[own, d], len(touched)) for d in range(soft.shape[0])], axis=1)
    return touched, grad, mean.T @ p, p.sum(axis=0)


def train(texts: list[str], labels: list[int]) -> Model | None:
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(SEED)
    number: dict[str, int] = {}
    flat, cuts, owner = array("i"), [0], []
    for i, text in enumerate(texts):
        ws = [number.setdefault(w, len(number)) for w in find(text.lower())]
        starts = list(range(0, max(1, len(ws) - STRETCH // 2), STRETCH)) if ws else []
        for a, b in zip(starts, [*starts[1:], len(ws)], strict=False):
            cuts.append(cuts[-1] + b - a)
            owner.append(i)
        flat.extend(ws)
    if not flat:
        return None
    flat, cuts, owner = np.array(flat, dtype=np.int32), np.array(cuts), np.array(owner)
    rows, count = buckets(list(number))
    first = np.cumsum(count) - count
    table = rng.normal(0, 0.01, (BUCKETS, WIDTH)).astype(np.float32)
    seen = np.full(BUCKETS, 1e-6, dtype=np.float32)
    soft, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    soft[:, 1] = 1.0  # the layers start with one direction for toxic words
    soft_seen, bias_seen = np.full(soft.shape, 1e-6), np.full(2, 1e-6)
    label = y[owner]
    use = np.ones(len(owner), dtype=bool)
    epochs = max(EPOCHS, min(60, STEPS * BATCH // len(owner)))  # small samples are gone through more often
    for epoch in range(epochs):
        if epoch >= 2:
            odds = (table @ (soft[:, 1] - soft[:, 0]).astype(np.float32))[rows]
            v = np.add.reduceat(odds, first) / count
            z = np.add.reduceat(v[flat], cuts[:-1]) / np.diff(cuts) + bias[1] - bias[0]
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, owner, z)
            use = (label == 0) | (z > 0) | (z >= best[owner])
        toxic, clean = np.flatnonzero(use & (label == 1)), np.flatnonzero(use & (label == 0))
        weight = np.where(label == 1, min(20.0, 0.5 * len(clean) / max(1, len(toxic))), 1.0)
        order = rng.permutation(np.flatnonzero(use))
        rate = RATE * (1 - epoch / epochs)
        for begin in range(0, len(order), BATCH):
            b = order[begin : begin + BATCH]
            n, at = cuts[b + 1] - cuts[b], cuts[b]
            short = (label[b] == 0) & (rng.random(len(b)) < 0.6)  # every part of a clean text is clean, down to a word
            part = np.where(short, np.minimum(n, 1 << rng.integers(0, 5, len(b))), n)
            n, at = part, at + rng.integers(0, n - part + 1)
            token = flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            touched, grad, to_soft, to_bias = gradients(table, soft, bias, token, n, (rows, count, first), label[b], weight[b])
            seen[touched] += (grad**2).mean(axis=1)
            table[touched] -= (rate * grad / np.sqrt(seen[touched])[:, None]).astype(np.float32)
            for value, g, total in ((soft, to_soft, soft_seen), (bias, to_bias, bias_seen)):
                total += g**2
                value -= rate * 0.3 * g / np.sqrt(total)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: F.Column) -> tuple[list[str], list[int]]:
    """Texts and labels of labelled rows, in the order of a hash of their ids, up to the bounds above."""
    ids = []
    marked = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropDuplicates(["id"])
    for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        ids.append(marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n))
    chosen = ids[0].unionByName(ids[1])  # TOXIC_ROWS + CLEAN_ROWS rows at most
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = slim.join(F.broadcast(chosen), "id")
    sizes = joined.groupBy("id", "y").agg(F.max(F.octet_length("text")).alias("n")).collect()
    share = {1: TOXIC_BYTES, 0: CLEAN_BYTES}
    taken = []
    for r in sorted(sizes, key=lambda r: zlib.crc32(str(r.id).encode())):
        if (r.n or 0) <= share[r.y]:
            share[r.y] -= r.n or 0
            taken.append((r.id,))
    if not taken:
        return [], []
    few = docs.sparkSession.createDataFrame(taken, chosen.select("id").schema)
    rows = joined.join(F.broadcast(few), "id", "left_semi").groupBy("id", "y").agg(F.min("text").alias("t")).collect()
    rows.sort(key=lambda r: str(r.id))
    return [r.t or "" for r in rows], [r.y for r in rows]


def score_toxicity(df: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with score_col, 0 to 1, from text_col alone; a null text counts as empty. Without a model all scores are 0.
    Texts without words have the score of the bias. Repeated rows stay; a column named score_col is replaced."""
    names = [c for c in df.columns if c != score_col]
    if model is None:
        return df.select(*names, F.lit(0.0).alias(score_col))
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            score = shared.value.scores([t or "" for t in batch.column(text_col).to_pylist()], known)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score, pa.float64())], [*names, score_col])
        known.clear()
        trim()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names).mapInArrow(run, f"{schema}, `{score_col}` double")


def held_out(id_col: str) -> F.Column:
    """Rows whose labels the model must not see."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """The model, from labelled rows that are not held out; null labels and ids without a document teach nothing."""
    model = fit(*sample(docs, labels, id_col, text_col, label_col, ~held_out(id_col)))
    release(docs.sparkSession)
    return model


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train_toxicity(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
