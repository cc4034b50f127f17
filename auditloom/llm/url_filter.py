"""URL filters: a list of rules by host and path, and, for urls that it doesn't know, rules mined from labelled urls by FP-growth.

A url becomes a set of tokens: labels of its host, directories, extension and names
of query parameters. FP-growth finds the sets that labelled urls share; those that
lead to the label ``bad`` often and surely enough become rules. Rules are kept in an
inverted index under their rarest token, so that a url is compared only with rules
that share it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_or_not, stored
from .manifest import LOWER, UPPER

#: Rules of the list: host and path, and the verdict.
LIST = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BAD = "bad"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def listed(host: Column, path: Column, rules: dict[str, str] = LIST) -> Column:
    """The longest rule of a list that fits: its host is the url's or a domain above it, and the url's path starts with its path.

    Rules are few enough to be written by hand, and go with the plan. What can fit is
    made from the url and looked up: every domain of the host with every beginning of
    the path that is as long as some rule's path.
    """
    lengths = sorted({len(x) - x.index("/") for x in rules})
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.filter(F.array(*(F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths)), lambda x: x.isNotNull())
    # Domains and beginnings from long to short; of two rules of one length that fit, the one of the longer host.
    known = F.array(*map(F.lit, rules))
    found = F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda s: F.concat(d, s))))
    fit = F.filter(found, lambda x: F.array_contains(known, x))
    best = F.reduce(fit, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))
    return F.when(host != "", best)


def tokens(url: Column) -> Column:
    """The distinct tokens of a url, none for null: h: labels of the host, p: directories, with # for numbers, e: the extension, q: names of parameters."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    masked = lambda x: F.when(x.rlike(r"^[0-9]+$"), F.lit("#")).otherwise(x)
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    directories = F.transform(F.slice(segments, F.lit(1), F.size(segments) - F.when(path.endswith("/"), 0).otherwise(F.least(F.lit(1), F.size(segments)))), masked)
    return F.coalesce(
        F.array_distinct(
            F.concat(
                named("h:", F.split(host, r"\.")),
                named("p:", directories),
                named("e:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
                named("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
            )
        ),
        F.array().cast("array<string>"),
    )


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The columns of ``sets`` (with an array items) and of ``rules`` (with index and antecedent) wherever a set holds a rule's whole antecedent.

    ``rules`` is broadcast if it is counted to be small, else Spark shuffles both by token.
    """
    held = sets.withColumn("index", F.explode("items"))
    return held.join(small_or_not(rules), "index").filter(F.size(F.array_except("antecedent", "items")) == 0).drop("index")


def mine(labelled: DataFrame, min_support: float = 0.005, min_rows: int = 20, min_confidence: float = 0.9, common: float = 0.95) -> DataFrame:
    """antecedent (sorted tokens), confidence, support (rows) and index (the rarest token) of the rules that urls (url, bad) show, stored.

    A rule needs ``min_support`` of the labelled urls, and ``min_rows`` of them at least,
    to hold its tokens and be bad, and ``min_confidence`` of those that hold its tokens
    to be bad. Tokens of more than ``common`` of all urls are left out: they tell
    nothing. A rule goes if another one with fewer of its tokens is as sure. Null urls
    and labels aren't learned from; repeated urls count as often as they are there.
    Without bad urls there are no rules.
    """
    read = labelled.filter("url is not null and bad is not null").select(tokens(F.col("url")).alias("items"), "bad")
    read = stored(read, "url-tokens")
    n = read.count()
    found = read.select(F.explode("items").alias("token")).groupBy("token").count()
    found = stored(found.filter(F.col("count") >= max(min_rows, min_support * n)), "url-frequent")
    # Tokens that are too rare for any rule, or in nearly every url, go before mining. What is left are 1 / min_support tokens a place at most.
    kept = [r["token"] for r in found.filter(F.col("count") <= common * n).collect()]
    told = read.select(F.concat(F.array_intersect("items", F.array(*map(F.lit, kept)).cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    told = stored(told.filter(F.size("items") > 0), "url-itemsets")
    m = told.count()
    schema = "antecedent array<string>, confidence double, support long, `index` string"
    if not m:
        return stored(read.sparkSession.createDataFrame([], schema), "url-rules")
    least = max(min_support * n, min_rows) / m
    model = FPGrowth(itemsCol="items", minSupport=min(least, 1.0), minConfidence=min_confidence).fit(told)
    rules = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.round(F.col("support") * m) >= least * m))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", F.round(F.col("support") * m).cast("long").alias("support"))
    rarest = rules.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token")).join(small_or_not(found), "token")
    rules = stored(rarest.groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("count", "token")).alias("index")), "url-mined")
    # A rule is a set of tokens too, so that the index finds the rules within it.
    sets = rules.select(F.col("antecedent").alias("items"), F.col("confidence").alias("own"))
    within = matches(sets, rules).filter((F.size("antecedent") < F.size("items")) & (F.col("confidence") >= F.col("own")))
    out = stored(rules.join(within.select(F.col("items").alias("antecedent")).distinct(), "antecedent", "left_anti"), "url-rules")
    discard(read, found, told, rules)
    return out


def judge(pages: DataFrame, rules: DataFrame, list_rules: dict[str, str] = LIST) -> DataFrame:
    """page_id, url, host, path, rule, verdict, and mined and confidence, of every row.

    The verdict is that of the longest rule of the list that fits, else block if a mined
    rule matches, else allow. mined is the surest such rule, its tokens joined by blanks
    (ties: more rows, then the first in order). Urls that are null or have no :// have an
    empty host and path; no rule of the list fits them. Empty paths begin with no
    rule's path. Repeated urls are judged once and alike. Other columns are left out.
    """
    read = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumn("rule", listed(F.col("host"), F.col("path"), list_rules))
    unknown = read.filter("rule is null and url is not null").select("url").distinct().withColumn("items", tokens(F.col("url")))
    found = matches(unknown, rules).groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "antecedent")).alias("best"))
    found = stored(found.select("url", F.array_join("best.antecedent", " ").alias("mined"), (-F.col("best.c")).alias("confidence")), "url-blocked")
    verdicts = F.create_map(*(F.lit(x) for pair in list_rules.items() for x in pair))
    joined = read.join(small_or_not(found), "url", "left")
    verdict = F.coalesce(F.element_at(verdicts, F.col("rule")), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return joined.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))


def labelled(pages: DataFrame, labels: DataFrame, list_rules: dict[str, str] = LIST) -> DataFrame:
    """url and bad: as the list has it where one of its rules fits, else as ``labels`` has it for the same number (bad if one of its rows is of quality 0)."""
    marked = labels.filter("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("low"))
    read = pages.select("page_id", "url", listed(host_of(F.col("url")), path_of(F.col("url")), list_rules).alias("rule"))
    verdicts = F.create_map(*(F.lit(x) for pair in list_rules.items() for x in pair))
    joined = read.join(marked, read["page_id"] == marked["doc_id"], "left")
    return joined.select("url", F.coalesce(F.element_at(verdicts, F.col("rule")) == "block", F.col("low")).alias("bad")).filter("bad is not null")
