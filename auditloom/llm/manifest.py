"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources, and a proof for each row.

Rows find their places without a global sort. Keys are strings of hexadecimal digits
in the order of the rows. Histograms of ever longer prefixes, made from one another,
tell how many rows stand before each prefix: within a prefix, those of smaller next
digits do. What is left are the few rows of the longest prefix, which a window
numbers. Ranks, as digits of base ``FANOUT``, then are the paths of a trie: level by
level, nodes meet under their rank less its last digit, and become one hash.

Proofs come down the same levels, once for each run of nodes and not for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, small_or_not, stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digits of a key whose histogram is made first, of a step from one histogram to the next, and rows of a longest prefix.
DEPTH, STEP, BUCKET = 14, 4, 4096
#: Added to a key's depth while a prefix holds more rows than that.
DEEPER = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """The bytes of a value and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    return hashed(*(field(changed.get(name, F.col(name))) for name in FIELDS))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tampered_with(doc_id: Column) -> Column:
    """True where five divides crc32 of the id as text; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the leaf of the tampered text (null for rows that are left alone), stored.

    Also ``group``, the source as a key (null first, then by bytes), and ``key``, which
    orders a source's rows by id (null first), then, as ids may repeat, by leaf, and
    rows that are the same in everything in any order.
    """
    digits = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    rows = docs.select(*FIELDS).select(
        "doc_id", "source", leaf_of().alias("leaf"), F.when(tampered_with(F.col("doc_id")), leaf_of(text=lowered(F.col("text")))).alias("tampered"), F.monotonically_increasing_id().alias("row")
    )
    rows = stored(rows, "manifest-leaves")
    group = F.coalesce(F.concat(F.lit("1"), F.hex(F.col("source").cast("binary"))), F.lit("0"))
    key = F.concat(F.coalesce(digits, F.lit("-" * 16)), F.upper("leaf"), F.lpad(F.hex("row"), 16, "0"))
    made = rows.select("doc_id", "source", "leaf", "tampered", group.alias("group"), key.alias("key"))
    made._stored_at = rows._stored_at
    return made


def histogram(rows: DataFrame) -> tuple[DataFrame, int]:
    """group, bucket (the first digits of the key) and rows, stored, and the number of digits: as many as it takes that no bucket is large."""
    depth = DEPTH
    while True:
        counts = stored(rows.groupBy("group", F.substring("key", 1, depth).alias("bucket")).agg(F.count("*").alias("rows")), "manifest-histogram")
        most = counts.agg(F.max("rows").alias("rows"), F.max(F.length("bucket")).alias("digits")).first()
        if (most["rows"] or 0) <= BUCKET or most["digits"] < depth:
            return counts, depth
        discard(counts)
        depth += DEEPER


def starts(counts: DataFrame, depth: int) -> DataFrame:
    """group, bucket, the number of rows of the group before it and in all (n), from histograms of growing prefixes.

    A window holds the prefixes of one parent, at most 16 ** STEP of them.
    """
    above = None
    for upper, lower in zip([0, *range(STEP, depth, STEP)], [*range(STEP, depth, STEP), depth], strict=True):
        level = counts.groupBy("group", F.substring("bucket", 1, lower).alias("bucket")).agg(F.sum("rows").alias("rows")) if lower < depth else counts
        level = level.withColumn("parent", F.substring("bucket", 1, upper))
        siblings = Window.partitionBy("group", "parent")
        before = F.coalesce(F.sum("rows").over(siblings.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if above is None:
            level = level.withColumn("start", before).withColumn("n", F.sum("rows").over(siblings))
        else:
            level = level.withColumn("before", before).join(above, ["group", "parent"]).withColumn("start", F.col("start") + F.col("before"))
        level = level.select("group", "bucket", "start", "n")
        above = level.withColumnRenamed("bucket", "parent")
    return level


def ranked(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """rows (with group and key) and rank, from 0 in order of key, and n, the rows of the group; and the tables to discard once that is stored."""
    counts, depth = histogram(rows)
    places = stored(starts(counts, depth), "manifest-places")
    joined = rows.withColumn("bucket", F.substring("key", 1, depth)).join(small_or_not(places), ["group", "bucket"])
    within = F.row_number().over(Window.partitionBy("group", "bucket").orderBy("key")) - 1
    return joined.withColumn("rank", F.col("start") + within).drop("bucket", "start", "key"), [counts, places]


def rise(nodes: DataFrame, done: list[DataFrame]) -> list[DataFrame]:
    """The levels of every group's tree from nodes (group, rank, n, node, more), lowest first, stored: group, place, n, members and node for each run.

    n is the number of members that the group has on this level, so that groups with
    FANOUT at most end there. A lone member stands for itself on the lowest level. A
    run has FANOUT members at most.
    """
    more = [c for c in nodes.columns if c not in ("group", "rank", "n")]
    levels, current = [], nodes.select("group", F.col("rank").alias("place"), "n", F.struct(*more).alias("member"))
    while True:
        runs = current.groupBy("group", F.shiftright("place", FANOUT.bit_length() - 1).alias("run")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "member"))).alias("members"))
        members = F.transform("members", lambda x: x["member"])
        level = runs.select("group", F.col("run").alias("place"), "n", members.alias("members"))
        node = F.when(F.col("n") == 1, F.col("members")[0]["node"]).otherwise(F.sha2(F.array_join(F.transform("members", lambda x: x["node"]), ""), 256))
        level = stored(level.withColumn("node", node), "manifest-level")
        if not levels:
            discard(*done)
        levels.append(level)
        rest = level.filter(F.col("n") > FANOUT)
        if rest.isEmpty():
            return levels
        current = rest.select("group", "place", F.ceil(F.col("n") / FANOUT).alias("n"), F.struct("node").alias("member"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """group and node of every tree's top."""
    found = [x.filter(F.col("n") <= FANOUT).select("group", "node") for x in levels]
    whole = found[0]
    for x in found[1:]:
        whole = whole.union(x)
    return whole


def beside(nodes: Column, at: Column) -> Column:
    """What stands before and after a member of a run."""
    return F.struct(F.array_join(F.slice(nodes, F.lit(1), at), "").alias("before"), F.array_join(F.slice(nodes, at + 2, F.lit(FANOUT)), "").alias("after"))


PATH = "array<struct<before:string,after:string>>"


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest members with all their fields, their group and place, what ``above`` says of the group, and path: what stands beside them on each level, lowest first, then the group's own path."""
    told = [c for c in above.columns if c not in ("group", "path")]
    paths = None
    for level in reversed(levels):
        own = level.filter(F.col("n") <= FANOUT).select("group", "place").join(above, "group").select("group", "place", "path", *told)
        paths = own.union(paths) if paths is not None else own
        runs = level.withColumnRenamed("n", "held").join(paths, ["group", "place"])
        runs = runs.select("group", F.col("place").alias("run"), "held", "path", *told, F.transform("members", lambda x: x["node"]).alias("nodes"), F.posexplode("members").alias("at", "member"))
        path = F.when(F.col("held") == 1, F.col("path")).otherwise(F.concat(F.array(beside(F.col("nodes"), F.col("at"))), F.col("path")))
        paths = runs.select("group", (F.col("run") * FANOUT + F.col("at")).alias("place"), path.alias("path"), *told, "member")
        if level is not levels[0]:
            paths = paths.drop("member")
    return paths


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda node, x: hashed(x["before"], node, x["after"]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, place, leaf, tampered, subroot, root and path of every row.

    path holds what stands beside the row's node in its run, level by level up to the
    root; folded(leaf, path) is root. Nulls are dashes in a leaf, rows without a source
    are a source of their own, the first; rows without an id come first in theirs, and
    rows that repeat an id are told apart by their leaves. Equal rows have a place each.
    Of an empty table there is no row. Texts are hashed whole where they lie; other
    columns of docs, whatever their names, are left out.
    """
    rows = leaves(docs)
    nodes, done = ranked(rows.withColumnRenamed("leaf", "node"))
    levels = rise(nodes, [rows, *done])
    sources = stored(tops(levels), "manifest-sources")
    # The sources' own order: their keys are strings of digits as well.
    over, done = ranked(sources.select(F.lit("").alias("group"), F.col("group").alias("key"), "node", F.col("group").alias("of")))
    upper = rise(over, done)
    root = tops(upper).first()  # one hash
    above = descend(upper, upper[-1].select("group", F.array().cast(PATH).alias("path")).distinct())
    above = stored(above.select(F.col("member.of").alias("group"), F.col("member.node").alias("subroot"), "path"), "manifest-subroots")
    discard(sources)
    found = descend(levels, above)
    return found.select(
        "member.doc_id", "member.source", "place", F.col("member.node").alias("leaf"), "member.tampered", "subroot", F.lit(root["node"] if root else None).cast("string").alias("root"), "path"
    )


def verified(docs: DataFrame) -> DataFrame:
    """The manifest's rows with their proof's digest, and whether each row, as it is after tampering, still leads to the root."""
    found = manifest(docs).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "source", "place")
