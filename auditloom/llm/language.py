"""Language of texts: sparse multinomial logistic regression on hashed character n-grams.

Features are counts of n-grams of one to three characters, weighted by inverse
document frequency and scaled to unit length. The frequencies come from every
training row. The weights are fitted by follow-the-regularised-leader with L1
and L2 penalties to a bounded sample, and a temperature fitted to the part of
the sample that training did not see turns margins into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import add_columns

BITS = 14
ORDERS = 3
#: Characters that are turned into n-grams at once, which bounds the memory that a long text takes.
PIECE = 1 << 19
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def buckets(codes: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """For each order the bucket of every n-gram that starts in codes."""
    h = np.zeros(len(codes), np.uint64)
    for order in range(ORDERS):
        h = h[: len(codes) - order] * np.uint64(0x9E3779B97F4A7C15) + codes[order:]
        yield ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """How often each bucket occurs in the whole text, lower-cased, with what is no letter as blank."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes < 128) & ~((codes >= 97) & (codes <= 122)), 32, codes).astype(np.uint64)
    total = np.zeros(1 << bits)
    for start in range(0, len(codes), PIECE):
        # A piece reaches into the next one, so that no n-gram is lost; what is counted twice there is taken back.
        piece = codes[start : start + PIECE + ORDERS - 1]
        for order, found in enumerate(buckets(piece, bits)):
            total += np.bincount(found[: PIECE if len(piece) > PIECE else None], minlength=1 << bits)
    return total


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> np.ndarray:
        x = counts(text) * self.idf
        return x / (np.sqrt(x @ x) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest class and its probability; ``und`` and 0 if there is no letter or nothing was learned."""
        if not self.classes or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax((self.features(text) @ self.weights + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], idf: np.ndarray, epochs: int = 6, batch: int = 32, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> Model:
    """rows: (text, class). Each text is learned whole and, for the sake of short texts, by a slice of it."""
    classes = sorted({y for _, y in rows})
    model = Model(classes, idf, np.zeros((len(idf), len(classes))), np.zeros(len(classes)))
    if len(classes) < 2:
        return model
    rng = np.random.default_rng(seed)
    # A fifth of the texts, with their slices, is set aside for the temperature.
    examples, aside, learned = [], [], []
    for k, i in enumerate(rng.permutation(len(rows))):
        text, y = rows[i]
        start = int(rng.integers(0, max(1, len(text) - 60)))
        for x in (text, text[start : start + int(rng.integers(8, 60))]):
            (aside if k % 5 == 0 else learned).append(len(examples))
            examples.append((x, classes.index(y)))
    learned = np.array(learned, np.int64)
    sparse = {}
    for i in range(len(examples)):
        x = model.features(examples[i][0])
        at = np.flatnonzero(x)
        sparse[i] = (at, x[at])
    shape = (len(idf) + 1, len(classes))  # the last row is the bias
    z, n, w = np.zeros(shape), np.zeros(shape), np.zeros(shape)

    def dense(ids: np.ndarray) -> np.ndarray:
        x = np.zeros((len(ids), shape[0]))
        x[:, -1] = 1.0
        for k, i in enumerate(ids):
            x[k, sparse[i][0]] = sparse[i][1]
        return x

    for _ in range(epochs):
        for ids in np.array_split(rng.permutation(learned), max(1, len(learned) // batch)):
            x = dense(ids)
            error = softmax(x @ w)
            error[np.arange(len(ids)), [examples[i][1] for i in ids]] -= 1
            g = x.T @ error
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            z += g - sigma * w
            n += g * g
            w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    model.weights, model.bias = w[:-1], w[-1]
    if len(aside):
        margins, y = dense(np.array(aside)) @ w, np.array([examples[i][1] for i in aside])
        loss = lambda t: -np.log(softmax(margins / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Over all training rows: how many texts hold each bucket. Each task sends one vector of fixed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += counts(text) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": [-1, *at], "n": [n, *total[at]]})

    rows = train.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = {r["bucket"]: r["n"] for r in rows}
    return found.pop(-1, 0), np.array([found.get(i, 0) for i in range(1 << BITS)], float)


def sample(train: DataFrame, per_class: int, at_most: int) -> list[tuple[str, str]]:
    """Up to per_class rows of each class and at_most in all, those of the smallest hash of id and text; of too many classes those with the most rows.

    Rows that repeat an id are told apart by their text, rows that repeat both count as one.
    """
    known = train.select("lang", F.xxhash64("doc_id", "text").alias("key"))
    classes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(at_most)
    n = max(1, min(per_class, at_most // max(1, classes.count())))
    order = Window.partitionBy("lang").orderBy("key")
    chosen = known.join(F.broadcast(classes.select("lang")), "lang").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n).select("lang", "key")
    # At most at_most rows, so they can be sent to every task.
    texts = train.withColumn("key", F.xxhash64("doc_id", "text")).join(F.broadcast(chosen.distinct()), ["lang", "key"], "left_semi")
    return sorted({(r["text"], r["lang"]) for r in texts.select("text", "lang").collect()})


def train(docs: DataFrame, learn_from: Column, per_class: int = 250, at_most: int = 4000) -> Model:
    """A model learned from text and lang of the rows where learn_from holds; per_class and at_most bound the rows that are fitted, each of them whole."""
    rows = docs.select("doc_id", "text", "lang").filter(learn_from & F.col("text").isNotNull() & F.col("lang").isNotNull())
    n, found = document_frequencies(rows)
    return fit(sample(rows, per_class, at_most), np.log((1.0 + n) / (1.0 + found)) + 1.0)


def identify(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; null texts and texts without a letter are ``und`` with score 0.

    Repeated rows stay repeated, very long texts are read whole, and of classes that are equally likely the first in order is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    read = docs.select("doc_id", held_out.alias("held_out"), "text")
    return add_columns(read, "text", lambda values: [shared.value.predict(x) for x in values], "lang_pred string, score double", drop=True)
