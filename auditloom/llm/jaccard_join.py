"""Documents whose sets of word shingles have a Jaccard similarity of 0.85 or more, by prefix filtering.

The words of a shingle and the percent are parameters of ``join``; four and 85, as below, are op6's.

1. Every text becomes its set of distinct four-word shingles, as 64-bit hashes.
   Texts of equal sets form a class; from here on a class stands for its texts.
2. In how many classes each shingle occurs is counted exactly. Hashes travel as
   blobs, one for each block of texts and range of hashes. Shingles that occur
   in one class only can't be shared; what comes back for a class is the list of
   its shared shingles with their frequencies. Shingles that very many classes
   hold are found beforehand, from counts within blocks of texts. Their
   frequency is known where a text is read, so that their holders are dealt over
   the ranges by class and never meet.
3. A class's shingles are put in order from rare to frequent, those that it has
   to itself first. Two sets that link share one of the first n - ceil(0.85 n) + 1
   of either. Classes whose prefix holds only shingles of their own are done.
4. Classes that share a prefix shingle are joined on it; pairs go through the
   length filter, the positional filter (what can follow in both orders) and the
   suffix filter (what 16 parts of both sets can share) and are verified once.
   Where many classes share a shingle, all are first paired with the one that
   has the fewest rarer shingles (the pivot, whose shingles are sent once for
   every few of its partners), and components are formed. Then only classes
   outside of that one's component are paired with the others of a similar
   length, so that a large group of near copies costs little more than its number
   of members, and yet every pair that could join two components is verified.

Links decide components; a class's label is the smallest id of its component's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import word_hashes
from .common import discard, slices, stored
from .components import components

#: Words of a shingle, and percent of the union that two sets must share, where ``join`` is given no others.
WORDS = 4
PERCENT = 85
#: Shingles of a range of hashes, and shared shingles of a part of the classes, that one task gets at a time; and into how many steps it cuts them.
IN_RANGE = 3_000_000
STEPS = 8
#: Shingles of a block of texts.
IN_BLOCK = 400_000
#: Partners of a pivot for which its shingles are sent once.
PARTNERS = 64
#: Classes that share a shingle up to which all their pairs are looked at.
FEW = 24
PARTS = 16
#: Copies of one text up to which its rows are shuffled together at the end, and how many classes may have more at most.
COPIES = 1000
HOT_CLASSES = 100_000
#: In how many classes of a block of texts a shingle must occur to be counted beforehand; how many so counted make it a hot one; and how many hot ones there are at most.
OFTEN = 8
HOT = 100_000
HOT_SHINGLES = 100_000
LOW = 48  # bits of a shingle's hash that are kept within its range


def shingle_sets(texts: list[str | None], n_words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of n_words words each, or of all its words if there are fewer."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    for first, last in word_hashes.grouped(raw):
        joined, begins = word_hashes.joined(raw[first:last])
        starts, _, h = word_hashes.words(joined)
        runs = word_hashes.sequences(h, n_words)
        bounds = np.searchsorted(starts, begins)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= n_words:
                yield np.unique(runs[a : b - n_words + 1])
            elif b > a:
                yield word_hashes.sequences(h[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little") >> 1


def classes(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """doc_id, cls and n_shingles of every row; cls is null for a text without words.

    Some rows have in often and times the shingles that many classes of a block of texts hold, and how many do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, np.ndarray] = {}
            size, done = 0, 0
            for part in slices(iter([batch])):
                names, sizes, counts = [], [], []
                for s in shingle_sets(part.column("text").to_pylist(), n_words):
                    names.append(class_of(s) if len(s) else None)
                    sizes.append(len(s))
                    if len(s) and names[-1] not in own:
                        own[names[-1]] = s
                        size += len(s)
                    if size > IN_BLOCK:
                        counts.append(counted(own))
                        own, size = {}, 0
                done += part.num_rows
                if done == batch.num_rows and own:
                    counts.append(counted(own))
                often, times = (np.concatenate(x) for x in zip(*counts, strict=True)) if counts else ([], [])
                nothing = [None] * (part.num_rows - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array([*nothing, x if len(x) else None], pa.list_(pa.int64())) for x in (often, times))],
                    ["doc_id", "cls", "n_shingles", "often", "times"],
                )

    def counted(own: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, n = np.unique(np.concatenate(list(own.values())), return_counts=True)
        return h[n >= OFTEN].view(np.int64), n[n >= OFTEN]

    read = docs.select("doc_id", "text")
    return read.mapInArrow(run, read.select("doc_id").schema.add("cls", "long").add("n_shingles", "long").add("often", ArrayType(LongType())).add("times", ArrayType(LongType())))


#: Hot shingles in order, and about how many classes hold each.
Hot = tuple[np.ndarray, np.ndarray]


def hot_shingles(rows: DataFrame, shingles: int) -> Hot:
    """The shingles of which counts within blocks come to HOT, or to one in HOT_SHINGLES of all shingles if that is more; so there are HOT_SHINGLES at most.

    A class counts once for each block, and blocks with few holders don't count.
    What is not hot is held by at most one in IN_BLOCK / OFTEN of all shingles besides.
    The counts only put shingles in order, for which any numbers do that are the same for all.
    """
    counts = rows.filter("often is not null").select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy(F.col("x.often").alias("shingle")).agg(F.sum("x.times").alias("n"))
    found = counts.filter(F.col("n") >= max(HOT, shingles // HOT_SHINGLES)).collect()
    h, n = np.array([x.shingle for x in found], np.int64).view(np.uint64), np.array([x.n for x in found], np.int64)
    order = np.argsort(h)
    return h[order], np.minimum(n[order], np.iinfo(np.int32).max).astype(np.int32)


def blobs(docs: DataFrame, bits: int, n_words: int = WORDS, hot: Hot | None = None) -> DataFrame:
    """Of each block of texts and each of 2**bits ranges: the classes, their sizes, how many shingles each has there, and these.

    Hot shingles are in ranges -1 to -2**bits, by shingle and class together, and are given by their numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, np.ndarray] = {}
            size = 0
            for part in slices(iter([batch])):
                for s in shingle_sets(part.column("text").to_pylist(), n_words):
                    if len(s) and (name := class_of(s)) not in own:
                        own[name] = s
                        size += len(s)
                    if size > IN_BLOCK:
                        yield sent(own)
                        own, size = {}, 0
            if own:
                yield sent(own)

    def sent(own: dict[int, np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in own.values()], np.int32)
        names = np.array(list(own), np.int64)
        h = np.concatenate(list(own.values()))
        part = (h >> np.uint64(64 - bits)).astype(np.int32)
        of = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
        if hot is not None:
            number = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
            there = np.flatnonzero(hot[0][number] == h)
            dealt = word_hashes.mixed(h[there] ^ names[of[there]].view(np.uint64))
            part[there] = -1 - (dealt >> np.uint64(64 - bits)).astype(np.int32)
            h[there] = number[there].astype(np.uint64)
        order = np.argsort(part, kind="stable").astype(np.int32)
        low = h[order].view(np.uint8).reshape(-1, 8)[:, : LOW // 8]
        of = of[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
        rows = []
        for a, b in zip(first, [*first[1:], len(h)], strict=True):
            there, n = np.unique(of[a:b], return_counts=True)
            rows.append((part[order[a]], names[there].tobytes(), sizes[there].tobytes(), n.astype(np.int32).tobytes(), low[a:b].tobytes()))
        names_of = ["range", "cls", "size", "n", "low"]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int32() if i == 0 else pa.binary()) for i in range(5)], names_of)

    return docs.select("text").mapInArrow(run, "range int, cls binary, size binary, n binary, low binary")


def numbers(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def shared_shingles(blobs: DataFrame, bits: int, parts: int, hot: Hot | None = None) -> DataFrame:
    """Of each range and part of the classes: the classes, sizes and shingles that two classes or more have, with frequencies."""

    def once(h: np.ndarray, of: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A class comes once for each block that holds it; here every shingle of it once."""
        order = np.lexsort((names[of], h))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (names[of[1:]] != names[of[:-1]])
        return h[new], of[new]

    def in_common(h: np.ndarray, of: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of shingles and the numbers of their classes: those that two classes or more have, and how many have them."""
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        more = same[1:] | same[:-1]
        h, of = h[more], of[more]
        h, of = once(h, of, names)
        _, back, frequency = np.unique(h, return_inverse=True, return_counts=True)
        keep = frequency[back] > 1
        return h[keep], of[keep], frequency[back][keep].astype(np.int32)

    def reduce(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        names, sizes, n = numbers(group["cls"], np.int64), numbers(group["size"], np.int32), numbers(group["n"], np.int32)
        raw = numbers(group["low"], np.uint8).reshape(-1, LOW // 8)
        of = np.repeat(np.arange(len(names), dtype=np.int32), n)
        found = []
        for step in range(STEPS):
            own = np.flatnonzero(raw[:, 0] % STEPS == step)
            h = np.zeros((len(own), 8), np.uint8)
            h[:, : LOW // 8] = raw[own]
            h = h.view(np.uint64).ravel()
            if key[0] < 0:
                h, own = once(h, of[own], names)
                found.append((hot[0][h.astype(np.int64)], own, hot[1][h.astype(np.int64)]))
            else:
                found.append(in_common(h, of[own], names))
        h, of, frequency = (np.concatenate(x) for x in zip(*found, strict=True))
        part = names[of] % parts
        order = np.lexsort((names[of], part))
        h, of, frequency, part = h[order], of[order], frequency[order], part[order]
        # The range holds the upper bits of what is not hot; where both hold a bit they agree.
        whole = (h if key[0] < 0 else h | (np.uint64(key[0]) << np.uint64(64 - bits))).view(np.int64)
        ends = np.searchsorted(part, np.arange(parts + 1))
        rows = []
        for p in np.flatnonzero(ends[1:] > ends[:-1]):
            a, b = ends[p], ends[p + 1]
            own = names[of[a:b]]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            count = np.diff(np.concatenate([first, [len(own)]])).astype(np.int32)
            rows.append((p, own[first].tobytes(), sizes[of[a:b]][first].tobytes(), count.tobytes(), whole[a:b].tobytes(), frequency[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["part", "cls", "size", "n", "shingle", "frequency"])

    return blobs.groupBy("range").applyInPandas(reduce, "part int, cls binary, size binary, n binary, shingle binary, frequency binary")


def least_shared(n: Column | np.ndarray, percent: int) -> Column | np.ndarray:
    """Of n shingles at least so many must be in the other set."""
    return (n * percent + 99) // 100


def candidates(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """cls, n, own (shingles that no other class has), tokens (the others, rare first), reach (how many of them belong to the prefix), parts.

    Only classes with a shared shingle in their prefix.
    """

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        names, sizes, n = numbers(group["cls"], np.int64), numbers(group["size"], np.int32), numbers(group["n"], np.int32)
        h, frequency = numbers(group["shingle"], np.int64), numbers(group["frequency"], np.int32)
        of, all_sizes = np.repeat(names, n), np.repeat(sizes, n)
        order = np.lexsort((h, frequency, of))
        of, h, all_sizes = of[order], h[order], all_sizes[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
        rows = []
        for a, b in zip(first, [*first[1:], len(of)], strict=True):
            size = int(all_sizes[a])
            own = size - int(b - a)
            reach = size - least_shared(size, percent) + 1 - own
            if reach > 0:
                rows.append((int(of[a]), size, own, h[a:b], int(reach), np.bincount(h[a:b] % PARTS, minlength=PARTS)))
        return pd.DataFrame(rows, columns=["cls", "n", "own", "tokens", "reach", "parts"])

    return shared.groupBy("part").applyInPandas(gather, "cls long, n int, own int, tokens array<long>, reach int, parts array<int>")


def can_link(a: str, b: str, percent: int) -> Column:
    """Length, positional and suffix filter for rows a and b that share the shingle at their positions.

    The positional filter takes the shingle for the first that both share, so
    that at most what follows can be shared. Of all rows of a pair that links,
    the one of its first shared shingle passes.
    """
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    length = (100 * F.least(n_a, n_b)) >= (percent * F.greatest(n_a, n_b))
    follows = F.least(n_a - F.col(f"{a}.at"), n_b - F.col(f"{b}.at"))
    alike = F.aggregate(F.zip_with(f"{a}.parts", f"{b}.parts", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    enough = lambda shared: (100 + percent) * shared >= percent * (n_a + n_b)
    return length & enough(follows) & enough(alike)


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: 100 * shared >= percent * union. Only shared shingles of two classes can be in both."""
    tokens = found.select("cls", "n", "tokens")
    one = tokens.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    two = tokens.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("t_a", "t_b")))
    return both.filter((100 + percent) * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def verified_stars(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The same for pairs (cls, pivot) of which one pivot may have very many; times says how often its tokens are sent, and partners are dealt among these."""
    tokens = found.select("cls", "n", "tokens")
    two = tokens.select(F.col("cls").alias("pivot"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b")).join(pairs.select("pivot", "times").distinct(), "pivot")
    two = two.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    dealt = pairs.join(tokens, "cls").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("times")).cast("int"))
    both = dealt.join(two, ["pivot", "times", "salt"]).withColumn("shared", F.size(F.array_intersect("tokens", "t_b")))
    return both.filter((100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("n_b"))).select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b"))


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.cls", f"{b}.cls").alias("a"), F.greatest(f"{a}.cls", f"{b}.cls").alias("b")]


def links(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A stored table of pairs (a, b) of classes that link: all of them up to FEW classes to a prefix shingle, beyond it enough to give the same components."""
    members = found.select("cls", "n", "own", "parts", F.posexplode(F.slice("tokens", F.lit(1), F.col("reach"))).alias("k", "token")).withColumn("at", F.col("k") + F.col("own")).drop("k")
    # Of classes that share a shingle, the pivot is the one with the fewest rarer ones.
    heads = members.groupBy("token").agg(F.count("*").alias("m"), F.min_by(F.struct("cls", "n", "own", "parts", "at"), F.struct("at", "cls")).alias("pivot")).filter("m > 1")
    # As a table of its own, so that Spark can split the rows of a shingle in the join.
    every = heads = stored(heads, "jaccard-pivots")
    members = stored(members.join(heads.select("token", "m", F.col("pivot.cls").alias("pivot")), "token"), "jaccard-members")
    times = F.pow(F.lit(2), F.ceil(F.log2(F.col("m") / PARTNERS + 1))).cast("int")
    heads = stored(heads.filter(F.col("m") > FEW).select("token", times.alias("times"), "pivot.*"), "jaccard-heads")
    discard(every)

    few, many = members.filter(F.col("m") <= FEW), members.filter(F.col("m") > FEW)
    near = few.alias("x").join(few.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls"))).filter(can_link("x", "y", percent)).select(*ordered("x", "y"))
    star = many.alias("x").join(heads.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") != F.col("y.cls"))).filter(can_link("x", "y", percent))
    star = stored(star.groupBy(F.col("x.cls").alias("cls"), F.col("y.cls").alias("pivot")).agg(F.min("y.times").alias("times")), "jaccard-stars")
    first = stored(verified(near.distinct(), found, percent).union(verified_stars(star, found, percent)).distinct(), "jaccard-links")
    discard(star)
    if heads.isEmpty():
        discard(members, heads)
        return first

    # Only where many share a shingle: those that did not come into the pivot's component, against all others of a similar length.
    label = components(first, "jaccard-first")
    of = label.select("node", "label")
    named = many.join(of.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    pivots = of.select(F.col("node").alias("pivot"), F.col("label").alias("main"))
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)))  # sets that link are in one band or in neighbours
    named = stored(named.join(pivots, "pivot", "left").withColumn("main", F.coalesce("main", "pivot")).withColumn("band", band), "jaccard-many")
    outside = named.filter("label <> main").withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))
    rest = outside.alias("x").join(named.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.label") != F.col("y.label")) & can_link("x", "y", percent)).select(*ordered("x", "y"))
    found_links = stored(first.union(verified(rest.distinct(), found, percent)), "jaccard-all-links")
    discard(members, heads, first, label, named)
    return found_links


def join(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, for shingles of n_words words and sets that share percent of their union.

    Texts of any length are read whole, a few at a time. Null texts and texts
    without words have no shingles, link with nothing and are components of
    their own. Rows that repeat an id or a text are kept; a
    null id is never a component's smallest unless it holds no other.
    """
    rows = stored(classes(docs, n_words), "jaccard-classes")
    size = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles"), F.count("*").alias("rows")).first()
    bits = 4
    while size["shingles"] > IN_RANGE << bits:
        bits += 1
    words = {} if n_words == WORDS else {"n_words": n_words}
    hot = hot_shingles(rows, size["shingles"])
    known = {"hot": hot} if len(hot[0]) else {}
    shared = shared_shingles(blobs(docs, bits, **words, **known), bits, 1 << bits, **known)
    found = stored(candidates(shared, percent), "jaccard-candidates")
    linked = links(found, percent)
    label = components(linked, "jaccard")
    discard(found, linked)
    smallest = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("copies"))
    of = label.join(smallest, F.col("node") == F.col("cls")).select("cls", "label", "smallest")
    of = of.join(of.groupBy("label").agg(F.min("smallest").alias("lowest")), "label").select("cls", "lowest")
    ids = stored(smallest.join(of, "cls", "left").select("cls", F.coalesce("lowest", "smallest").alias("lowest"), "copies"), "jaccard-components")
    discard(label)
    return with_component(rows, ids, max(COPIES, size["rows"] // HOT_CLASSES))


def with_component(rows: DataFrame, ids: DataFrame, copies: int) -> DataFrame:
    """doc_id, n_shingles and component_id of rows; classes of more than ``copies`` rows are broadcast, so that their rows stay where they lie.

    There are at most HOT_CLASSES of those, since copies is at least the number of rows divided by it.
    """
    known = rows.filter("cls is not null")
    hot = F.broadcast(ids.filter(F.col("copies") > copies).select("cls", "lowest"))
    cold = ids.filter(F.col("copies") <= copies).select("cls", "lowest")
    parts = [known.join(hot, "cls"), known.join(hot, "cls", "left_anti").join(cold, "cls"), rows.filter("cls is null").withColumn("lowest", F.col("doc_id"))]
    columns = ["doc_id", "n_shingles", F.coalesce("lowest", "doc_id").alias("component_id")]
    return parts[0].select(columns).union(parts[1].select(columns)).union(parts[2].select(columns))
