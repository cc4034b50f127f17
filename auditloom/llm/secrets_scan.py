"""Secrets in texts, by DataFrame functions alone: exact patterns, and a battery of randomness tests.

The patterns give the base spans. Besides, every long run of token characters
is a candidate. Its encoding is inferred from the characters it uses, separators
between them aside; under that encoding's alphabet three tests are made:
chi-squared of uniform use, runs above and below the middle, and correlation of
neighbours. Fisher's method joins them into the probability that random text looks
as odd as the token does; what random text hardly ever looks like is no find.

How easily ordinary text passes depends on its length, and on nothing in the
corpus: the p-value of a token is the chance that letters as frequent as those of
ordinary text are used as evenly as its own, by the chi-squared distribution that
these frequencies shift; of a hexadecimal one, that all its letters are among the
first six. Within each class of lengths, the p-value up to which the expected share
of false finds stays below ``fdr`` decides (Benjamini and Hochberg's rule, on bins).
Numbers look like ordinary numbers at any length, and are no finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .host_rules import let

# Kinds in the order of the contract and its patterns, and alphabets of encodings.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "dec": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "word": "abcdefghijklmnopqrstuvwxyz",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: The chance that two letters of English text are the same, and that one is among a to f. Other languages' letters are less even.
SAME, FIRST_SIX = 0.0655, 0.317
#: The probability below which random text does not look like this, and the p-value above which nothing is found.
ODD, MOST = 0.01, 0.01
#: p-values are binned by tenths of their decimal logarithm, up to this many.
BINS = 120
#: Matches whose places are summed up together; one array of all would be copied for each.
BLOCK = 128


def found(text: Column, pattern: str, keep=None) -> Column:
    """Start, end and match of each match, from left to right, as an array; starts follow from the lengths of what lies between."""
    kind = "array<struct<start:int,end:int,match:string>>"
    none = F.array().cast(kind)

    def place(both: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), none.alias("out"))

        def add(done: Column, x: Column) -> Column:
            a = done["at"] + x["gap"]
            b = a + F.length(x["match"])
            return F.struct(b.alias("at"), F.concat(done["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["match"].alias("match")))).alias("out"))

        return F.aggregate(both, zero, add, lambda done: done["out"])

    def in_blocks(both: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / BLOCK).cast("int")), lambda k: F.slice(both, k * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, placed)

    def placed(blocks: Column) -> Column:
        size = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["match"]))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda done, n: F.struct((done["at"] + n).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out"))
        firsts = F.aggregate(F.transform(blocks, size), zero, add, lambda done: done["out"])
        return F.flatten(F.zip_with(blocks, firsts, place))

    def spans(matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), F.length)
        both = F.zip_with(gaps, matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
        every = let(both, in_blocks)
        return F.filter(every, keep) if keep else every

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))


def base_spans(text: Column) -> Column:
    """kind (number), start and end of the patterns' matches, by start and kind."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    # A match whose second group is too short is dropped without another try from within it.
    assign = found(text, ASSIGN, lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6)
    access = F.when(F.contains(text, F.lit("AKIA")), found(text, ACCESS)).otherwise(none)

    def of_kind(own: Column, kind: int) -> Column:
        return F.transform(own, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    return F.array_sort(F.concat(of_kind(assign, 0), of_kind(access, 1), of_kind(found(text, HEX), 2)))


def encoding(bare: Column) -> Column:
    """By the characters of a token without its separators; every token has one."""
    has = lambda x: bare.rlike(x)
    both = has("[0-9]") & has("[A-Za-z]")
    return (
        F.when(has("^[0-9]+$"), "dec")
        .when(has("^([0-9a-f]+|[0-9A-F]+)$") & both, "hex")
        .when(has("^[A-Z2-7]+$") & both, "base32")
        .when(has("^[0-9a-z]+$") & both, "lower")
        .when(has("^[0-9A-Z]+$") & both, "upper")
        .when(has("^([a-z]+|[A-Z]+)$"), "word")
        .when(has("^[A-Za-z]+$"), "letters")
        .otherwise("base64")
    )


def normal_above(z: Column) -> Column:
    """The share of a normal distribution above z, by a logistic curve that is off by less than 0.0002."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return F.lit(1.0) / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def cube_root(chi: Column, free: Column) -> Column:
    """Wilson and Hilferty's normal value of a chi-squared one."""
    return (F.pow(F.greatest(chi / free, F.lit(0.0)), F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))


def tested(tokens: DataFrame) -> DataFrame:
    """Adds n, like_random (0 to 1), the joint probability of the three tests for a random token of this encoding, and p, that of ordinary text to be so even."""
    alphabet = F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair))
    letters = F.when(F.col("encoding").isin("hex", "word"), F.lower("bare")).when(F.col("encoding") == "base64", F.col("core")).otherwise(F.col("bare"))
    df = tokens.withColumn("letters", letters).withColumn("alphabet", alphabet[F.col("encoding")])
    df = df.withColumn("x", let(F.col("alphabet"), lambda a: F.transform(F.filter(F.split("letters", ""), lambda c: c != ""), lambda c: F.instr(a, c).cast("double"))))
    df = df.withColumn("n", F.size("x").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    df = df.withColumn("mean", F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.col("n"))
    squares = let(F.col("x"), lambda x: F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, v: s + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))))
    high = let((F.col("k") + 1) / 2, lambda m: F.transform("x", lambda v: (v > m).cast("int")))
    pairs = lambda x: F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x) - 1).alias("b"))
    df = df.withColumn("squares", squares).withColumn("high", high)
    changes = F.aggregate(F.transform(pairs(F.col("high")), lambda p: (p["a"] != p["b"]).cast("double")), F.lit(0.0), lambda s, v: s + v)
    spread = let(F.col("mean"), lambda m: F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - m) * (v - m)))
    lagged = let(F.col("mean"), lambda m: F.aggregate(F.transform(pairs(F.col("x")), lambda p: (p["a"] - m) * (p["b"] - m)), F.lit(0.0), lambda s, v: s + v))
    df = df.withColumn("ones", F.aggregate("high", F.lit(0.0), lambda s, v: s + v)).withColumn("runs", changes + 1).withColumn("spread", spread).withColumn("lagged", lagged)
    free = F.col("k") - 1
    chi = F.col("k") / F.col("n") * F.col("squares") - F.col("n")
    z_chi = cube_root(chi, free)
    # Letters of ordinary text shift the distribution; Patnaik's way to say by how much.
    shift = F.col("n") * F.greatest(F.col("k") * SAME - 1, F.lit(0.0))
    scale, free_shifted = (free + 2 * shift) / (free + shift), (free + shift) * (free + shift) / (free + 2 * shift)
    as_even = normal_above(-cube_root(chi / scale, free_shifted))
    p = F.when(F.col("encoding") == "dec", F.lit(1.0)).when(F.col("encoding") == "hex", F.pow(F.lit(FIRST_SIX), F.length(F.regexp_replace("bare", "[0-9]", "")))).otherwise(as_even)
    twice = 2 * F.col("ones") * (F.col("n") - F.col("ones"))
    expected = twice / F.col("n") + 1
    deviation = F.sqrt(F.greatest(twice * (twice - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1)), F.lit(1e-9)))
    z_runs = F.when(twice == 0, F.lit(8.0)).otherwise(F.abs(F.col("runs") - expected) / deviation)
    z_lag = F.when(F.col("spread") == 0, F.lit(8.0)).otherwise(F.abs(F.col("lagged") / F.col("spread")) * F.sqrt("n"))
    # Fisher: half of the sum of -2 ln p; its tail has a closed form for three tests.
    half = -(F.log(normal_above(z_chi)) + F.log(2 * normal_above(z_runs)) + F.log(2 * normal_above(z_lag)))
    half = F.greatest(half, F.lit(0.0))
    df = df.withColumn("half", half).withColumn("p", p)
    return df.withColumn("like_random", F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2))


def thresholds(scored: DataFrame, fdr: float) -> DataFrame:
    """For each class of lengths that has one: the lowest bin from which on the finds are true enough.

    From counts by class of length and bin; whatever the corpus, these are few rows.
    """
    counts = scored.groupBy("length", "bin").agg(F.count("*").alias("tested"), F.sum(F.col("possible").cast("long")).alias("possible"))
    up, whole = Window.partitionBy("length").orderBy(F.desc("bin")), Window.partitionBy("length")
    counts = counts.withColumn("finds", F.sum("possible").over(up)).withColumn("all", F.sum("tested").over(whole))
    share = F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("all") / F.col("finds")
    return counts.filter((F.col("finds") > 0) & (share <= fdr)).groupBy("length").agg(F.min("bin").alias("from_bin"))


def apart(rows: DataFrame) -> DataFrame:
    """row, start, end and match of the tokens that touch no base span; the spans of one text are put in order once."""
    none = F.lit(None).cast("string").alias("match")
    tokens = rows.filter(F.size("tokens") > 0).select("row", F.inline("tokens"))
    base = rows.filter((F.size("tokens") > 0) & (F.size("base") > 0)).select("row", F.inline("base")).select("row", "start", "end", none)
    order = Window.partitionBy("row").orderBy("start")
    is_base = F.col("match").isNull()
    last = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = tokens.union(base).withColumn("last", last).withColumn("following", following)
    return both.filter(~is_base & (F.coalesce("last", "start") <= F.col("start")) & (F.coalesce("following", "end") >= F.col("end"))).select("row", "start", "end", "match")


def scan(docs: DataFrame, fdr: float = 0.1) -> DataFrame:
    """doc_id, base (array of start, kind, end) and added (the same, kind 3) of every row, repeated ones too.

    Null and empty texts have no spans; long ones are read whole. Added spans touch no base span.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", base_spans(text).alias("base"), found(text, TOKEN).alias("tokens"))
    rows = stored(rows, "secrets-rows")
    tokens = apart(rows).withColumn("core", F.rtrim(F.col("match"), F.lit("="))).withColumn("bare", F.translate("core", "-_", ""))
    tokens = tokens.withColumn("encoding", encoding(F.col("bare"))).filter(F.length("bare") > 1)
    scored = tested(tokens.select("row", "start", "end", "core", "bare", "encoding"))
    size = F.floor(F.log2(F.greatest(F.col("n"), F.lit(10.0)) / 20) * 2).cast("int").alias("length")
    bin_of = F.least(F.floor(-10 * F.log10(F.greatest("p", F.lit(1e-300)))), F.lit(BINS)).cast("int").alias("bin")
    scored = stored(scored.select("row", "start", "end", size, bin_of, ((F.col("like_random") >= ODD) & (F.col("p") <= MOST)).alias("possible")), "secrets-scored")
    # At most one row for each class of lengths, and these are half powers of two.
    passed = scored.filter("possible").join(F.broadcast(thresholds(scored, fdr)), "length").filter(F.col("bin") >= F.col("from_bin"))
    added = passed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end"))).alias("added"))
    return rows.drop("tokens").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


def written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", let(kinds, lambda k: F.get(k, x["kind"])), x["start"], x["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, all spans as text, and the number of added ones."""
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return scanned.select("doc_id", *map(of_kind, range(3)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"))
