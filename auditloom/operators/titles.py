"""The title index, and reports whose title is in it already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrow import ascii_fold
from ..functions.text import first_filled, normalized_title, singular_title, slug_title


def first_per(df: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """The first row of each key by order; which row that is does not depend on how rows are dealt out."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_k = 1").drop("_k")


def with_title_keys(df: DataFrame, title: Column, fold: bool = True) -> DataFrame:
    """Adds normalized_title and singular_title."""
    df = df.withColumn("normalized_title", normalized_title(title, ascii_fold if fold else None))
    return df.withColumn("singular_title", singular_title(F.col("normalized_title")))


def title_index(urls: DataFrame, fold: bool = True) -> DataFrame:
    """url, title, normalized_title, singular_title and pos from rows of url and pos: blank urls go, of equal urls the first stays."""
    kept = first_per(urls.filter("url <> ''").select("url", "pos"), "url").withColumn("title", slug_title(F.col("url")))
    return with_title_keys(kept, F.col("title"), fold).select("url", "title", "normalized_title", "singular_title", "pos")


def two_of_each(index: DataFrame, key: str, order: Column, name: str) -> DataFrame:
    """For each key its first two entries in an order, as an array: enough to find the first of another url."""
    ranked = index.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_k <= 2")
    entries = F.array_sort(F.collect_list(F.struct("_k", "url", "title")))
    return ranked.groupBy(F.col(key).alias(f"_{name}")).agg(entries.alias(name))


def duplicates(reports: DataFrame, index: DataFrame, unique_urls: bool = False, dealt_over: int | None = None) -> DataFrame:
    """Adds match (kind exact or plural, url, title) to reports that have url, normalized_title and singular_title; null if there is none.

    Exact: the first entry of the same normalized title and another url.
    Plural, if there is no exact one: the last entry of the same singular title and another url.
    Each key of the index is reduced to two entries first, so no report meets more than one row.
    unique_urls says that no url is twice in the index, as title_index leaves it; dealt_over is how many
    tasks its keys are dealt over, without which Spark's own number holds, however many rows there are.
    """
    deal = lambda df, by: df.repartition(dealt_over, by) if dealt_over else df
    known = index.filter("url <> ''")
    known = known if unique_urls else first_per(deal(known, "url"), "url")
    exact = two_of_each(deal(known, "normalized_title"), "normalized_title", F.asc("pos"), "exact")
    plural = two_of_each(deal(known, "singular_title"), "singular_title", F.desc("pos"), "plural")
    # Blank titles match nothing: as nulls they are not sent to one task.
    titled = lambda c: F.when(F.col("normalized_title") != "", F.col(c))
    joined = reports.withColumns({"_by_exact": titled("normalized_title"), "_by_plural": titled("singular_title")})
    joined = deal(joined, "_by_exact").join(exact, F.col("_by_exact") == F.col("_exact"), "left")
    joined = deal(joined, "_by_plural").join(plural, F.col("_by_plural") == F.col("_plural"), "left")

    def other(entries: str, kind: str) -> Column:
        found = F.get(F.filter(entries, lambda x: x["url"] != F.col("url")), F.lit(0))
        return F.when(found.isNotNull(), F.struct(F.lit(kind).alias("kind"), found["url"].alias("url"), found["title"].alias("title")))

    return joined.withColumn("match", F.coalesce(other("exact", "exact"), other("plural", "plural"))).drop("exact", "plural", "_exact", "_plural", "_by_exact", "_by_plural")


def has_duplicate(reports: DataFrame, index: DataFrame, unique_urls: bool = False) -> DataFrame:
    """Adds titles to reports that have url, normalized_title and singular_title: whether duplicates finds a match, and not which.

    Equal normalized titles have equal singular ones, so that an entry of another url and the same
    singular title is all that is asked for; there is one if the least or the greatest url is another.
    """
    known = index.filter("url <> ''")
    known = known if unique_urls else first_per(known, "url")
    held = known.groupBy(F.col("singular_title").alias("_title")).agg(F.min("url").alias("_least"), F.max("url").alias("_most"))
    joined = reports.withColumn("_by", F.when(F.col("normalized_title") != "", F.col("singular_title"))).join(held, F.col("_by") == F.col("_title"), "left")
    other = (F.col("_least") != F.col("url")) | (F.col("_most") != F.col("url"))
    return joined.withColumn("titles", F.coalesce(other, F.lit(False))).drop("_by", "_title", "_least", "_most")


def current_title() -> Column:
    return first_filled(F.col("card_title"), F.col("h1"), F.col("page_title"))
