"""Cards, pages, title index, issues and seen state from sources and files."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from ..functions.arrow import cards as read_cards
from ..operators.titles import first_per, title_index
from ..schema import INDEXED_TITLE, ISSUE, SEEN, TEXT
from .http import fetch
from .sitemaps import sitemap_urls
from .versions import Versions

__all__ = ["cached_index", "cards_of", "fetched_pages", "fresh", "saved_issues", "saved_pages", "saved_payloads", "seen_state", "sitemap_urls"]


def cards_of(payloads: DataFrame) -> DataFrame:
    """Cards from rows of page and reports (markup), in feed order, of each url the first."""
    found = payloads.select("page", F.posexplode(read_cards("reports")).alias("at", "card")).select("page", "at", "card.*").filter("url <> ''")
    # Pages are few and their cards are bounded: one window over them gives the feed's order.
    found = found.withColumn("pos", F.row_number().over(Window.orderBy("page", "at")).cast("long"))
    return first_per(found, "url").select("title", "url", "summary", "published_on", "pos")


def saved_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads saved as JSON files, numbered by file name."""
    read = spark.read.schema("reports string").json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_path"))
    return read.withColumn("page", F.row_number().over(Window.orderBy("_file"))).select("page", "reports")


def fetched_pages(cards: DataFrame, timeout: float = 30.0) -> DataFrame:
    """The cards with the html of their url. Filter before: every row is fetched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(html=[fetch(x, timeout).decode("utf-8", "replace") for x in batch["url"]])

    return cards.mapInPandas(run, StructType([*cards.schema.fields, StructField("html", TEXT)]))


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """A url (the file's path) and html for each file of a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def seen_state(spark: SparkSession, path: str) -> tuple[bool, DataFrame]:
    """Whether a poll has run before, and the urls seen; nothing where there is no table yet."""
    versions = Versions(spark, path)
    if not (last := versions.last()):
        return False, spark.createDataFrame([], SEEN)
    return True, spark.read.schema(SEEN).parquet(f"{path}/{versions.read(last)['table']}")


def fresh(refreshed_at: str | None, now: dt.datetime, max_age_hours: float = 24) -> bool:
    """Whether a time is at most so old; what is no time is not fresh."""
    try:
        at = dt.datetime.fromisoformat((refreshed_at or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return False
    if at.tzinfo is None:
        at = at.replace(tzinfo=dt.UTC)
    return now - at <= dt.timedelta(hours=max_age_hours)


def cached_index(spark: SparkSession, path: str, scan, now: dt.datetime | None = None, max_age_hours: float = 24, fold: bool = True) -> DataFrame:
    """The title index from its table if that is fresh, else scanned anew (scan() gives url and pos) and written."""
    now, versions = now or dt.datetime.now(dt.UTC), Versions(spark, path)
    while True:
        last = versions.last()
        held = versions.read(last) if last else {}
        if fresh(held.get("refreshed_at"), now, max_age_hours):
            return first_per(spark.read.schema(INDEXED_TITLE).parquet(f"{path}/{held['table']}"), "url")
        table = f"titles-{uuid.uuid4().hex}"
        title_index(scan(), fold).write.parquet(f"{path}/{table}")
        if versions.claim(last + 1, {"table": table, "refreshed_at": now.isoformat()}):
            versions.tidy()
            return spark.read.schema(INDEXED_TITLE).parquet(f"{path}/{table}")
        versions.drop(table)  # another poll has made one meanwhile


def saved_issues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ISSUE).json(path, multiLine=True)
