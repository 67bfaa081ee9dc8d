"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per text, linear softmax, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.llm.common import ASCII_LOWER, byte_runs
from code_impact.session import cut_lineage

# Bytes of texts whose subwords are held at a time.
_MOST_BYTES = 1 << 20
_SPACES = bytes(32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


@dataclass(frozen=True)
class Features:
    """Which subwords of a text count: UTF-8 byte n-grams inside words with their ends, whole words, pairs of words.

    A pair of a word with itself is one pair for all words. With ``once``, all
    subwords of words that follow themselves are one subword, so that repeating a word tells no more about it.
    ``blank`` subwords without a vector are averaged in too, so that a few subwords alone do not make a sure score.
    """

    sizes: tuple[int, ...] = (3, 4, 5)
    words: bool = True
    pairs: bool = True
    lower: bool = False
    once: bool = False
    bits: int = 17
    blank: int = 0

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket ids of all subwords of the texts and the index of the text each comes from. Whole texts are read."""
        data = b"".join(b" " + t.translate(_SPACES) + b" " for t in texts)
        data = data.translate(ASCII_LOWER) if self.lower else data
        b = np.frombuffer(data, np.uint8)
        owner_at = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
        space = b == 32
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int32)
        at = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
        value = np.where(space[starts[0] :], np.uint64(0), (b[starts[0] :].astype(np.uint64) + np.uint64(1)) * _POWERS[at & 4095])
        words = np.add.reduceat(value, starts - starts[0])
        words = (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        owner = owner_at[starts]
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])

        passed = np.zeros(len(b) + 1, np.int32)
        np.cumsum(space, out=passed[1:])
        repeats = np.zeros(len(b), bool)
        if self.once and again.any():
            repeats[starts[0] :] = np.repeat(again, np.diff(np.append(starts, len(b))))
        shift = np.uint32(32 - self.bits)
        ids, owners = [], []
        rolled = b.astype(np.uint32)
        for size in range(2, max(self.sizes, default=0) + 1):
            if len(b) < size:
                break
            rolled = rolled[:-1] * np.uint32(0x01000193) + b[size - 1 :]
            if size in self.sizes:
                # No space inside; one at either end marks the start or the end of a word.
                inside = np.flatnonzero(passed[size - 1 : len(b)] == passed[1 : len(b) - size + 2])
                mixed = (rolled[inside] ^ np.uint32(size * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                bucket = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1) >> shift
                ids.append(np.where(repeats[inside + 1], np.uint32(0), bucket))
                owners.append(owner_at[inside])
        if self.words:
            bucket = (words >> np.uint64(64 - self.bits)).astype(np.uint32)
            ids.append(np.where(again & self.once, np.uint32(0), bucket))
            owners.append(owner)
        if self.pairs:
            first = np.flatnonzero(owner[1:] == owner[:-1])
            both = (words[first] * np.uint64(3) + (words[first + 1] >> np.uint64(1))) * np.uint64(0x94D049BB133111EB)
            ids.append(np.where(again[first + 1], np.uint32(0), (both >> np.uint64(64 - self.bits)).astype(np.uint32)))
            owners.append(owner[first])
        return np.concatenate(ids), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """Vectors (buckets x dim), output (dim x 2) and the log odds added to a text's score."""

    features: Features
    vectors: np.ndarray
    output: np.ndarray
    bias: float

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Softmax of (average of the subword vectors) x output, for label 1.

        Averaging is linear, so each bucket's share of the logit is taken first and then averaged. Texts are read in runs of
        bounded bytes, a longer one alone, at some 40 bytes of memory for each of theirs.
        """
        share = (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)
        logits = np.full(len(texts), self.bias)
        for lo, hi in byte_runs(texts, _MOST_BYTES):
            ids, owners = self.features.of(texts[lo:hi])
            n = np.bincount(owners, minlength=hi - lo)
            logits[lo:hi] += np.bincount(owners, weights=share[ids], minlength=hi - lo) / np.maximum(n + self.features.blank, 1)
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def train(texts: list[bytes], labels: np.ndarray, features: Features, dim: int = 4, steps: int = 48_000, most_epochs: int = 40, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and output weights by stochastic gradient descent, one text a step, with a step size per bucket (AdaGrad).

    The texts are gone through until ``steps`` are done, but at most ``most_epochs`` times.
    """
    rng = np.random.default_rng(seed)
    # Vectors begin at zero, so that a subword that was never seen says nothing.
    vectors = np.zeros((1 << features.bits, dim), np.float32)
    output = rng.normal(0, dim**-0.5, (dim, 2)).astype(np.float32)
    seen_v = np.full(1 << features.bits, 1e-6, np.float32)
    seen_o = 1e-6
    # The sample's own log odds are given, so that vectors only learn what tells the labels apart.
    odds = np.array([0, np.log(max(1, (labels == 1).sum()) / max(1, (labels == 0).sum()))], np.float32)
    bags = []
    for text in texts:
        ids, _ = features.of([text])
        found, counts = np.unique(ids, return_counts=True)
        bags.append((found, (counts / max(len(ids) + features.blank, 1)).astype(np.float32)))
    epochs = min(most_epochs, -(-steps // max(1, len(bags))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(bags)):
            found, weight = bags[k]
            if not len(found):
                continue
            held = vectors[found]
            mean = weight @ held
            logits = mean @ output + odds
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output @ p
            grad_o = np.outer(mean, p)
            seen_o += float((grad_o**2).sum())
            share = float(back @ back) / dim
            seen_v[found] += weight**2 * share
            vectors[found] = held - step * (weight / np.sqrt(seen_v[found]))[:, None] * back
            output -= step * grad_o / np.sqrt(seen_o)
    return vectors, output


def held_out(id_: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a row without an id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, features: Features, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", max_rows: int = 4000, max_bytes: int = 32 << 20, **options) -> Model:
    """Fit on at most ``max_rows`` labelled documents of at most ``max_bytes`` together, half of each label, by a hash of their id.

    One row stands for an id, however often it is repeated: that whose text has the smallest hash. A text that would take its
    label beyond its half of the bytes is passed over.

    ``labels`` has (id, label 0/1); rows without id or label are left out, of several labels the largest counts. The share of
    label 1 among all labelled rows sets the log odds of a score. With no labelled documents of one label the model is
    constant at the smoothed share. Training runs in one task on the bounded sample; a lost task gives the same model again.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ones, zeros = share.get(1, 0), share.get(0, 0)
    prior = float(np.log((ones + 1) / (zeros + 1)))
    constant = Model(features, np.zeros((1 << features.bits, 1), np.float32), np.zeros((1, 2), np.float32), prior)
    if not ones or not zeros:
        return constant
    half = max_rows // 2
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(half) for k in (0, 1)]
    # At most ``max_rows`` narrow rows.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    sample = cut_lineage(found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label")))
    kept, left = [], {0: max_bytes // 2, 1: max_bytes // 2}
    for r in sample.select("id", "label", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id").collect():
        if r["size"] <= left[r["label"]]:
            left[r["label"]] -= r["size"]
            kept.append(r["id"])
    sample = sample.where(F.col("id").isin(kept))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"id": [], "text": [], "label": []})]).sort_values(["id", "text"])
        marks = rows["label"].to_numpy(np.int64)
        if len(set(marks)) < 2:
            return
        vectors, output = train([t.encode() for t in rows["text"]], marks, features, **options)
        yield pd.DataFrame({"vectors": [vectors.tobytes()], "output": [output.tobytes()]})

    made = sample.repartition(1).mapInPandas(fitted, "vectors binary, output binary").collect()
    if not made:
        return constant
    row = made[0]
    output = np.frombuffer(row["output"], np.float32).reshape(-1, 2)
    vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, len(output))
    return Model(features, vectors, output, prior)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 of each whole text; null is the empty text."""
    # Only each bucket's share of the logit travels to the tasks.
    share = (model.vectors @ (model.output[:, 1] - model.output[:, 0])).reshape(-1, 1).astype(np.float32)
    small = Model(model.features, share, np.array([[0, 1]], np.float32), model.bias)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(small.probabilities([(t or "").encode() for t in texts]), dtype="float64")

    return scored(text)
