"""Quality of texts by compression: which of two zstandard dictionaries, of good and of bad text, shortens it more.

A text is compressed whole, in pieces, once with each dictionary. The
difference of the sizes over their sum, and the size over the length, go
through a logistic curve fitted to labelled texts that no dictionary holds.

The labelled texts are a bounded sample of rows, read whole: half of them are cut
into pieces, of which a bounded sample makes the dictionaries; of the other half
only the sizes reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, slices

#: Bytes compressed at once; small, so that what counts is the dictionary and not the text's own past.
PIECE = 2048
DICTIONARY = 48 << 10
LEVEL = 3


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes] | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = 0.0

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "weights": self.weights, "bias": self.bias}

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if "_compressors" not in self.__dict__:
            made = []
            for raw in self.dictionaries:
                words = zstandard.ZstdCompressionDict(raw)
                words.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False))
            self._compressors = made
        return self._compressors

    def features(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw or not self.dictionaries:
            return np.zeros(4)
        good, bad = (sum(len(c.compress(raw[i : i + PIECE])) for i in range(0, len(raw), PIECE)) for c in self.compressors())
        difference, ratio = (bad - good) / (bad + good), min(good, bad) / len(raw)
        return np.array([10 * difference, ratio, ratio * ratio, 10 * difference * ratio])

    def score(self, text: str | None) -> float:
        if not self.dictionaries:
            return float(1 / (1 + np.exp(-self.bias)))
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights + self.bias, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method, with a small ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z / len(z) + np.diag(penalty), z.T @ (p - y) / len(z) + penalty * w)
        w -= np.clip(step, -2, 2)
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def dictionary(pieces: list[bytes]) -> bytes | None:
    """A dictionary trained on pieces of text, or where they are too few or too uniform for that as many of them as it holds."""
    if len(pieces) < 8:
        return None
    total = sum(map(len, pieces))
    size = min(DICTIONARY, max(1024, total // 4))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY]


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", per_class: int = 1500, pieces: int = 4000) -> Model:
    """A model learned from the rows of labels where learn_from holds.

    per_class bounds the rows of each label, those of the smallest hash of the
    id, and pieces the stretches of PIECE bytes of each label, those of the
    smallest hash; they come from whole texts. Rows are chosen by id alone, so
    that only their texts are read out of docs. Repeated rows count as one;
    without labels, or with one label only, every score is the share of label 1.
    """
    known = labels.filter(learn_from & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("label"))
    ids: dict[int, int] = {}
    for value in (0, 1):
        ids |= {r["doc_id"]: value for r in known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()}
    model = Model()
    if not ids:
        return model
    wanted = F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": list(ids), "label": list(ids.values())})))
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").filter(F.col("text").isNotNull()).select("text", "label", F.xxhash64("text").alias("key"))
    cut = [r for value in (0, 1) for r in pieces_of(rows.filter((F.col("key") % 2 == 0) & (F.col("label") == value))).orderBy("key", "at").limit(pieces).collect()]
    made = [dictionary([bytes(r["piece"]) for r in cut if r["label"] == value]) for value in (1, 0)]
    if all(made):
        model.dictionaries = (made[0], made[1])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sizes = add_columns(rows.filter("key % 2 <> 0"), "text", lambda values: [tuple(map(float, shared.value.features(x))) for x in values], ", ".join(f"f{k} double" for k in range(4)), drop=True)
    found = sorted(tuple(r) for r in sizes.select("key", "label", *(f"f{k}" for k in range(4))).distinct().collect())
    y = np.array([r[1] for r in found], float)
    rate = (sum(ids.values()) + 1) / (len(ids) + 2)
    if not model.dictionaries or len(set(y)) < 2:
        return Model(bias=float(np.log(rate / (1 - rate))))
    model.weights, model.bias = logistic(np.array([r[2:] for r in found]), y)
    return Model(model.dictionaries, model.weights, model.bias)


def pieces_of(rows: DataFrame) -> DataFrame:
    """label, key (a hash of text and place), at and piece of every PIECE bytes of every text; shorter ends than 32 bytes are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            labels, keys = batch.column("label").to_pylist(), batch.column("key").to_pylist()
            for label, key, text in zip(labels, keys, batch.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                own = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE) if len(raw) - i >= 32]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(own), pa.int64()), pa.array([key] * len(own), pa.int64()), pa.array(range(len(own)), pa.int32()), pa.array(own, pa.binary())], ["label", "key", "at", "piece"])

    cut = rows.withColumn("label", F.col("label").cast("long")).mapInArrow(run, "label long, key long, at int, piece binary")
    return cut.dropDuplicates(["key", "at"]).withColumn("key", F.xxhash64("key", "at"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs and a column ``score`` of every row; null counts as the empty text, and a long text is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return add_columns(docs, "text", lambda values: [(shared.value.score(x),) for x in values], "score double")
