"""Removal of repeated passages: sentences inside of spans that occurred before, anywhere in the corpus.

A text is cut into sentences at line feeds, at end marks followed by white
space, and, since lists and long sentences shall have pieces too, after the
word of the least hash of every ten words in a row (winnowing), so that only a
word that is repeated over and over makes pieces of more than ten. Cuts depend on the nine words around them at most; a
passage is thus cut alike wherever it occurs, but for its edges. A span is a run of three
sentences, or of more if it takes that to reach twelve words. Spans are hashed
over their words, lower-cased, and joined over the whole corpus; all but a
span's first occurrence (by document id, then place) are marked, and sentences
in marked spans are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_hashes
from .common import add_columns, stored

SENTENCES = 3
LEAST_WORDS = 12
#: Words of a piece at most.
PIECE = 10
END_MARKS = tuple(b".!?")


def cuts(h: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Where words of these hashes close a piece: at the ends of sentences, and at the least of every PIECE words of one sentence.

    Of equal words the last counts; in a row of one word over and over, every PIECE-th.
    """
    out = closes.copy()
    if len(h) < PIECE:
        return out
    sentence = np.cumsum(closes) - closes
    own = np.flatnonzero(sentence[PIECE - 1 :] == sentence[: len(h) - PIECE + 1])
    least = PIECE - 1 - np.lib.stride_tricks.sliding_window_view(h, PIECE)[own, ::-1].argmin(axis=1)
    at = np.unique(own + least)
    changes = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    nth = at - changes[np.searchsorted(changes, at, "right") - 1]
    out[at[(nth == 0) | (nth % PIECE == PIECE - 1)]] = True
    return out


def sentences(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the first and last byte of its sentences and, for each sentence, the hash of the span that begins there and its number of sentences.

    Given as (starts, ends, spans), spans having two columns; a span of no sentences is none.
    """
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    for first, last in word_hashes.grouped(raw):
        joined, begins = word_hashes.joined(raw[first:last])
        starts, ends, h = word_hashes.words(joined)
        bounds = np.searchsorted(starts, begins)
        lines = np.cumsum(joined == 10)
        closes = np.isin(joined[ends - 1], END_MARKS)
        if len(starts):
            closes[:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
            closes[-1] = True
        closes = cuts(h, closes)
        total = np.concatenate([[np.uint64(0)], np.cumsum(word_hashes.mixed(h) * word_hashes.powers(word_hashes.ODD, len(h)))])
        undo = word_hashes.powers(word_hashes.INVERSE, len(h) + 1)
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            after = a + np.flatnonzero(closes[a:b]) + 1  # the word behind each sentence
            if not len(after):
                yield after, after, np.zeros((0, 2), np.int64)
                continue
            before = np.concatenate([[a], after[:-1]])
            # The span that begins at a sentence ends with the third one from there, or later if it has too few words.
            n = np.arange(len(after))
            until = np.maximum(n + SENTENCES - 1, np.searchsorted(after, before + LEAST_WORDS))
            whole = until < len(after)
            stop = after[np.minimum(until, len(after) - 1)]
            spans = word_hashes.mixed((total[stop] - total[before]) * undo[before] + (stop - before).astype(np.uint64)).view(np.int64)
            yield starts[before] - begins[k], ends[after - 1] - begins[k], np.stack([spans, np.where(whole, until - n + 1, 0)], axis=1)


def text_key() -> Column:
    """Tells rows of one id apart by their text; rows that repeat both are one document."""
    return F.xxhash64("text")


def spans(docs: DataFrame) -> DataFrame:
    """span (hash), doc_id, key, at (number of the first sentence) and size (sentences) of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, own = [], []
            for k, (_, _, found) in enumerate(sentences(batch.column("text").to_pylist())):
                at = np.flatnonzero(found[:, 1])
                row.append(np.full(len(at), k))
                own.append(np.column_stack([found[at], at]))
            row, own = np.concatenate(row or [np.zeros(0, int)]), np.concatenate(own or [np.zeros((0, 3), np.int64)])
            for i in range(0, len(row), 100_000):
                rows, part = pa.array(row[i : i + 100_000]), own[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(part[:, 2].astype(np.int32)), pa.array(part[:, 1].astype(np.int32))], ["span", "doc_id", "key", "at", "size"])

    read = docs.select("doc_id", text_key().alias("key"), "text")
    schema = read.drop("text").schema
    return read.mapInArrow(run, f"span long, doc_id {schema['doc_id'].dataType.simpleString()}, key long, at int, size int")


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, key and marked (array of at and size): the spans of each document that are no first occurrences.

    Spans are counted first, in part before they are shuffled, so that only the
    few that occur twice meet in the join; there Spark can split a span that
    very many documents share.
    """
    found = spans(docs)
    twice = found.groupBy("span").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at")).alias("first")).filter("n > 1")
    twice = stored(twice.select("span", F.col("first.doc_id").alias("id0"), F.col("first.key").alias("key0"), F.col("first.at").alias("at0")), "repeated-spans")
    later = found.join(twice, "span").filter(~(F.col("doc_id").eqNullSafe(F.col("id0")) & (F.col("key") == F.col("key0")) & (F.col("at") == F.col("at0"))))
    return later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "size")).alias("marked"))


def cleaned(text: str | None, marked: str | None) -> tuple[str | None, int, int, str]:
    """The text without the marked sentences, the numbers of sentences and of removed ones, and the removed stretches in code points."""
    (starts, ends, _), *_ = [*sentences([text]), (np.zeros(0, int),) * 3]
    gone = np.zeros(len(starts), bool)
    for x in (marked or "").split(",") if marked else []:
        at, size = map(int, x.split(":"))
        gone[at : at + size] = True
    if not gone.any():
        return text, len(starts), 0, ""
    raw = text.encode("utf-8", "surrogatepass")
    decode = lambda a, b: raw[a:b].decode("utf-8", "surrogatepass")
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept, removed, at, points = [], [], 0, 0
    for first, behind in zip(edge[::2], edge[1::2], strict=True):
        a, b = int(starts[first]), int(ends[behind - 1])
        points += len(decode(at, a))
        size = len(decode(a, b))
        removed.append(f"{points}:{points + size}")
        kept.append(decode(at, a))
        points, at = points + size, b
    kept.append(decode(at, len(raw)))
    # What stood between removed sentences is one blank or line feed.
    out = kept[0].rstrip(" ")
    for x in kept[1:]:
        bare = x.lstrip()
        gap = "\n" if "\n" in x[: len(x) - len(bare)] or out.endswith("\n") else " "
        out = f"{out.rstrip()}{gap if out.strip() and bare else ''}{bare}" if bare else out.rstrip()
    return out, len(starts), int(gone.sum()), ",".join(removed)


def dedup(docs: DataFrame) -> DataFrame:
    """The columns of docs with the text cleaned, and n_sentences, n_removed and removed (start:end of what was removed, in code points of the given text).

    Null texts stay null; a text whose sentences are all repeated becomes empty.
    A passage that a text repeats itself loses its later occurrences too.
    """
    docs = docs.drop("n_sentences", "n_removed", "removed")
    marked = F.array_join(F.transform("marked", lambda x: F.concat_ws(":", x["at"], x["size"])), ",").alias("marked")
    found = marks(docs).select("doc_id", "key", marked)
    # The columns of docs stay together in one, whatever they are called.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"), "text", text_key().alias("own"))
    joined = whole.join(found, whole["rest.doc_id"].eqNullSafe(found["doc_id"]) & whole["own"].eqNullSafe(found["key"]), "left")
    read = joined.select("rest", F.concat(F.coalesce("marked", F.lit("")), F.lit("|"), "text").alias("text"))

    def run(values: list[str | None]) -> list[tuple]:
        return [cleaned(None, None) if x is None else cleaned(*x.split("|", 1)[::-1]) for x in values]

    out = add_columns(read, "text", run, "text string, n_sentences int, n_removed int, removed string", drop=True)
    back = [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return out.select(*back, "n_sentences", "n_removed", "removed")
