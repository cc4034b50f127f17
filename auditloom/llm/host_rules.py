"""Quality rules on documents and on their hosts, by DataFrame functions alone.

Each document is measured once; rules turn the measures into failures. Failures
are summed by host, and each host's rate is shrunk towards the rate of all hosts
by a beta prior fitted to the hosts' rates by moments. The host's verdict then
decides, with the document's own failures, what is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, small_or_not, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    """The runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once; as a plain name it would be computed for each element of a lambda."""
    return F.transform(F.array(value), body)[0]


def window_hashes(words: Column) -> Column:
    """A hash of each run of eight words, in order; none if there are fewer words."""

    def hashes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    each = let(F.transform(words, lambda w: F.xxhash64(w)), hashes)
    return F.when(F.size(words) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))


def repeat_words(windows: DataFrame) -> DataFrame:
    """Of (row, runs): row and the number of words in runs that occur twice or more.

    Only rows that have such a run come here. The rows of one text stay
    together, so its size bounds a group.
    """
    runs = windows.select("row", F.posexplode("runs").alias("at", "run")).repartition("row")
    twice = runs.withColumn("n", F.count("*").over(Window.partitionBy("row", "run"))).filter("n > 1")
    gap = F.lead("at").over(Window.partitionBy("row").orderBy("at")) - F.col("at")
    return twice.select("row", F.least(F.lit(WINDOW), F.coalesce(gap, F.lit(WINDOW))).alias("own")).groupBy("row").agg(F.sum("own").alias("n_repeat_words"))


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the five measures of every row; null text counts as empty."""
    read = docs.select("doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    size = lambda x: F.size(x).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    base = (
        read.withColumn("words", words_of(F.col("text")))
        .withColumn("lines", lines)
        .withColumn("runs", window_hashes(F.col("words")))
        .select(
            "doc_id",
            "host",
            size(F.col("words")).alias("n_words"),
            F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (size(F.col("lines")) - size(F.array_distinct("lines"))).alias("n_dup_lines"),
            F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.col("runs")).alias("runs"),
        )
    )
    # The runs of the few texts that repeat themselves are kept until they are counted; a row's number stands for it, as ids may repeat.
    base = stored(base.withColumn("row", F.monotonically_increasing_id()), "rule-measures")
    return base.drop("runs").join(repeat_words(base.filter("runs is not null").select("row", "runs")), "row", "left").select("doc_id", "host", *MEASURES[:4], F.coalesce("n_repeat_words", F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def soft_failures(symbols_per_word: float = 0.3, dup_lines_per_word: float = 0.05, shortest: float = 2.0, longest: float = 15.0) -> Column:
    """How many of the milder rules a document fails: symbols, repeated lines, mean length of words."""
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    rules = [F.col("n_symbols") > symbols_per_word * F.col("n_words"), F.col("n_dup_lines") > F.greatest(F.lit(2.0), dup_lines_per_word * F.col("n_words")), (F.col("n_words") > 0) & ~mean.between(shortest, longest)]
    return sum(rule.cast("int") for rule in rules)


def host_rates(measured: DataFrame) -> DataFrame:
    """host, documents, failures and the shrunk rate.

    With rates r of hosts of n documents, the prior's mean m is the rate of all
    documents, and its strength is m(1-m)/v - 1, v being the hosts' variance
    beyond what drawing n documents gives; it is held between 1 and 1000.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("documents"), F.sum((F.col("base_failed") | (F.col("soft") > 0)).cast("long")).alias("failures"))
    hosts = stored(hosts, "rule-host-counts")
    rate = F.col("failures") / F.col("documents")
    mean = F.sum("failures") / F.greatest(F.sum("documents"), F.lit(1))
    prior = hosts.agg(mean.alias("mean"), (F.sum("failures") * 1.0).alias("all"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("spread"), F.coalesce(F.avg(1 / F.col("documents")), F.lit(1.0)).alias("draw"))
    m = F.col("mean")
    excess = F.greatest(F.col("spread") - m * (1 - m) * F.col("draw"), F.lit(1e-9))
    # One row, whatever the number of hosts.
    prior = prior.select("mean", F.least(F.greatest(m * (1 - m) / excess - 1, F.lit(1.0)), F.lit(1000.0)).alias("strength")).first()
    mean, strength = F.lit(prior["mean"]).cast("double"), F.lit(prior["strength"]).cast("double")
    shrunk = (F.col("failures") + mean * strength) / (F.col("documents") + strength)
    return hosts.select("host", "documents", "failures", shrunk.alias("rate"), mean.alias("overall"))


def judge(docs: DataFrame, host: str = "source", blocked: float = 0.5, suspect: float = 2.0) -> DataFrame:
    """The measures, base_failed, the host's shrunk rate and verdict, and kept, for every row.

    A host whose shrunk rate exceeds ``blocked`` is blocked: nothing of it is
    kept. One whose rate exceeds ``suspect`` times the overall rate is suspect:
    one mild failure suffices there to reject a document, elsewhere two do.
    A null host is a host of its own; an empty text has no words and fails.
    """
    measured = stored(measures(docs, host).withColumn("base_failed", base_failed()).withColumn("soft", soft_failures()), "rule-documents")
    verdict = F.when(F.col("rate") > blocked, "blocked").when(F.col("rate") > suspect * F.col("overall"), "suspect").otherwise("good")
    hosts = small_or_not(stored(host_rates(measured).select("host", "rate", verdict.alias("verdict")), "rule-hosts"))
    # eqNullSafe: documents without a host are judged together.
    joined = measured.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    kept = ~F.col("base_failed") & (F.col("verdict") != "blocked") & (F.col("soft") < F.when(F.col("verdict") == "suspect", 1).otherwise(2))
    return joined.select("doc_id", *MEASURES, "base_failed", kept.alias("kept"), "host", F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict"), F.col("soft").alias("soft_failures"))
