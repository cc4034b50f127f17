"""Benchmark decontamination by greedy string tiling.

Runs of ``k`` words that a document shares with a benchmark item (found by a
rolling Karp-Rabin hash) are the seeds. Seeds that follow each other make
matches; again and again the longest match none of whose words is marked yet is
marked in both texts. The share of an item's words that end up marked is its
coverage. Since tiles may lie in any order, a passage whose sentences were
moved about is covered like one that was not.

Seeds are kept as stretches of diagonals (place in the document less place in the
item), so that a word that is repeated over and over makes no more of them than
the texts have words. A benchmark of a checked size is sent to the tasks; a larger
one meets the documents in a join. Both ways give the same.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, slices

K = 4
THRESHOLD = 0.5
#: Pairs of places that are listed at once.
PAIRS = 1 << 19
#: Benchmark words up to which its seeds are sent to every task; beyond it seeds are joined by Spark.
SENT_WORDS = 1_000_000
BASE = np.uint64(0x100000001B3)
CLEAN = str.maketrans({x: " " for x in string.punctuation})
COLUMNS = "contaminated boolean, max_coverage double, n_items int, items string"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().translate(CLEAN).split()


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of k numbers."""
    n = len(ids) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        h = h * BASE + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    return h


def stretches(p: np.ndarray, d: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds at places p of diagonals d, or n of them in a row: joined where they follow each other; (place, diagonal, seeds)."""
    order = np.lexsort((p, d))
    p, d, n = p[order], d[order], np.ones(len(p), np.int64) if n is None else n[order]
    again = np.zeros(len(p), bool)
    again[1:] = (p[1:] == p[:-1]) & (d[1:] == d[:-1])
    p, d, n = p[~again], d[~again], n[~again]
    first = np.ones(len(p), bool)
    first[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + n[:-1])
    at = np.flatnonzero(first)
    return p[at], d[at], np.add.reduceat(n, at) if len(at) else n


def tiles(p: np.ndarray, d: np.ndarray, n: np.ndarray, k: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (document word, item word, words) of the tiles, from stretches of seeds; of equal ones the first in the document comes first."""
    first, heap = int(p.min()), [(-int(c) - k + 1, int(a), int(a - b)) for a, b, c in zip(p, d, n, strict=True)]
    heapq.heapify(heap)
    in_doc, in_item, found = np.zeros(int((p + n).max()) - first + k, bool), np.zeros(size, bool), []
    left = size
    while heap and left >= k:
        length, a, b = heapq.heappop(heap)
        taken = in_doc[a - first : a - first - length] | in_item[b : b - length]
        if not taken.any():
            found.append((a, b, -length))
            in_doc[a - first : a - first - length] = in_item[b : b - length] = True
            left += length
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start >= k:
                heapq.heappush(heap, (start - end, a + start, b + start))
    return found


class Benchmark:
    """The seeds of all items; words that occur in no item have no number."""

    def __init__(self, items: list[tuple[int, str]], k: int = K):
        self.k, self.vocabulary, self.size, ids, owner, at = k, {}, {}, [], [], []
        for n, (_, text) in enumerate(items):
            words = words_of(text)
            self.size[n] = len(words)
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            owner += [n] * len(words)
            at += range(len(words))
        self.names = [name for name, _ in items]
        self.ids, self.owner, self.at = np.array(ids, np.int64), np.array(owner, np.int64), np.array(at, np.int64)
        h = rolling(self.ids, k)
        self.starts = np.flatnonzero(self.owner[: len(h)] == self.owner[k - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
        h = h[self.starts]
        order = np.argsort(h, kind="stable")
        self.hashes, self.starts = h[order], self.starts[order]

    def seeds(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretches of runs of k words that a text shares with items; diagonals are by places in all items together."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
        none = np.zeros(0, np.int64)
        if len(ids) < self.k or not len(self.hashes):
            return none, none, none
        known = ids >= 0
        run = known[: len(ids) - self.k + 1].copy()
        for i in range(1, self.k):
            run &= known[i : i + len(run)]
        places = np.flatnonzero(run)
        if not len(places):
            return none, none, none
        h = rolling(ids, self.k)[places]
        low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        shared = high > low
        places, low, n = places[shared], low[shared], (high - low)[shared]
        total, found, at = np.cumsum(n), [], 0
        while at < len(places):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            own = n[at:stop]
            p = np.repeat(places[at:stop], own)
            q = self.starts[np.arange(len(p)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[at:stop], own)]
            same = np.ones(len(p), bool)  # equal hashes may be of unequal words
            for i in range(self.k):
                same &= ids[p + i] == self.ids[q + i]
            found.append(stretches(p[same], (p - q)[same]))
            at = stop
        return stretches(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (none, none, none)

    def coverages(self, text: str | None) -> list[tuple[object, float]]:
        """Of each item that shares a run with the text: its id and its coverage."""
        p, d, n = self.seeds(text)
        owner = self.owner[p - d]
        out = []
        for i in np.unique(owner):
            own = owner == i
            begin = np.searchsorted(self.owner, i)
            out.append((self.names[i], covered(p[own], d[own] + begin, n[own], self.k, self.size[i])))
        return out


def covered(p: np.ndarray, d: np.ndarray, n: np.ndarray, k: int, size: int) -> float:
    return sum(length for _, _, length in tiles(p, d, n, k, size)) / size


def verdict(coverages: list[tuple[object, float]], threshold: float) -> tuple[bool, float, int, str]:
    over = sorted({i for i, c in coverages if c >= threshold}, key=lambda x: (x is None, x))
    return bool(over), max((c for _, c in coverages), default=0.0), len(over), ",".join("null" if x is None else str(x) for x in over)


def judge(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, sent_words: int = SENT_WORDS) -> DataFrame:
    """The columns of docs, and contaminated, max_coverage, n_items and items (ids of the items covered) of every row.

    An item of fewer than k words has no seed and is never found; null texts
    and null items share nothing. Rows of one item id count as one item, covered
    if one of its texts is; an item without an id counts, named ``null``. Ids are
    integers or strings. Repeated and very long documents are judged whole, each row.
    """
    docs = docs.drop("contaminated", "max_coverage", "n_items", "items")
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    # A word and what follows it take two characters at least.
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > 2 * sent_words:
        return judge_joined(docs, items, k, threshold)
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda x: (x[0] is None, x))
    known = docs.sparkSession.sparkContext.broadcast(Benchmark(rows, k))

    return add_columns(docs, "text", lambda values: [verdict(known.value.coverages(x), threshold) for x in values], COLUMNS)


def seed_rows(df: DataFrame, kept: list[str], prefix: str, k: int) -> DataFrame:
    """A row for every run of k words: the kept columns, its place, the number of words and a 64-bit hash of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            words = [words_of(x) for x in batch.column("text").to_pylist()]
            n = [max(0, len(x) - k + 1) for x in words]
            row = pa.array(np.repeat(np.arange(len(words)), n))
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(x) for x in n)]).astype(np.int32)
            runs = [" ".join(x[i : i + k]) for x in words for i in range(len(x) - k + 1)]
            size = np.repeat(np.array([len(x) for x in words], np.int32), n)
            yield pa.RecordBatch.from_arrays([*(batch.column(x).take(row) for x in kept), pa.array(at), pa.array(size), pa.array(runs, pa.string())], [*kept, f"{prefix}_at", f"{prefix}_size", "run"])

    schema = df.select(*kept).schema.add(f"{prefix}_at", "integer").add(f"{prefix}_size", "integer").add("run", "string")
    return df.select(*kept, "text").mapInArrow(run, schema).withColumn("run", F.xxhash64("run"))


def judge_joined(docs: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    """The same for a benchmark of any size: documents and items meet in a join on their seeds, which Spark can split where a run is common.

    A document is known by its id and a hash of its text, an item by a hash of both.
    """
    key = F.xxhash64("text").alias("_key")
    items = items.withColumn("_item", F.xxhash64("item_id", "text"))
    hits = seed_rows(docs.select(F.col("doc_id").alias("_id"), key, "text"), ["_id", "_key"], "doc", k).drop("doc_size").join(seed_rows(items, ["_item"], "item", k), "run")

    def tile(group: pd.DataFrame) -> pd.DataFrame:  # the places that one document and one item share
        p, q = group["doc_at"].to_numpy(np.int64), group["item_at"].to_numpy(np.int64)
        return group[["_id", "_key", "_item"]].head(1).assign(coverage=covered(*stretches(p, p - q), k, int(group["item_size"].iloc[0])))

    schema = hits.select("_id", "_key", "_item").schema.add("coverage", "double")
    pairs = hits.groupBy("_id", "_key", "_item").applyInPandas(tile, schema).join(items.select("_item", "item_id"), "_item")
    one = F.struct(F.col("item_id").isNull().alias("none"), "item_id")
    found = pairs.groupBy("_id", "_key").agg(F.max("coverage").alias("_most"), F.sort_array(F.collect_set(F.when(F.col("coverage") >= threshold, one))).alias("_over"))
    own = docs.withColumn("_own", key)
    out = own.join(found, own["doc_id"].eqNullSafe(found["_id"]) & (F.col("_own").eqNullSafe(F.col("_key"))), "left")
    n = F.coalesce(F.size("_over"), F.lit(0))
    names = F.array_join(F.transform("_over", lambda x: F.coalesce(x["item_id"].cast("string"), F.lit("null"))), ",")
    return out.select(*docs.columns, (n > 0).alias("contaminated"), F.coalesce("_most", F.lit(0.0)).alias("max_coverage"), F.when(F.col("_over").isNull(), 0).otherwise(n).alias("n_items"), F.coalesce(names, F.lit("")).alias("items"))
