"""Sitemaps as a data source: a partition for each sitemap, entries in document order, indexes and compressed files followed."""

from __future__ import annotations

import re
import urllib.request
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.arrow import clean
from .http import AGENT

CHUNK = 1 << 16
#: Entries of a sitemap and sitemaps of an index that places have room for; the protocol allows 50,000 of both.
PER_MAP, MAPS = 1_000_000_000, 1_000_000
LOC = re.compile(rb"(?is)<loc(?:\s[^>]*)?>(.*?)</loc\s*>")
CDATA = re.compile(r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$")

Chunks = Iterable[bytes]


def plain(chunks: Chunks) -> Iterator[bytes]:
    """The bytes as they are, or what they are compressed from, which may be several members one after the other."""
    start, unzip = b"", None
    for chunk in chunks:
        if unzip is None:
            start += chunk
            if len(start) < 2:
                continue
            chunk, unzip = start, zlib.decompressobj(31) if start[:2] == b"\x1f\x8b" else False
        while unzip and chunk:
            yield unzip.decompress(chunk)
            chunk, unzip = (unzip.unused_data, zlib.decompressobj(31)) if unzip.eof else (b"", unzip)
        if not unzip:
            yield chunk
    if unzip is None:
        yield start


def live(url: str, timeout: float) -> Iterator[bytes]:
    """A url's bytes as they come; an answer that is no success raises."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
        while chunk := answer.read(CHUNK):
            yield chunk


def strict(chunks: Chunks) -> Iterator[tuple[bool, str]]:
    """Whether the document is an index, first with an empty text, then with the text of each loc element of the root's namespace. Elements go as soon as they end."""
    parser, root, index = ElementTree.XMLPullParser(("start", "end")), None, False
    for chunk in plain(chunks):
        parser.feed(chunk)
        for event, x in parser.read_events():
            space, _, name = x.tag.rpartition("}")
            if root is None:
                root, index = x, name == "sitemapindex"
                own = space
                yield index, ""
            elif event == "end" and name == "loc" and space in ("", own):
                yield index, " ".join(x.itertext())
            elif event == "end" and name in ("url", "sitemap"):
                root.clear()
    parser.close()


def lenient(chunks: Chunks) -> Iterator[tuple[bool, str]]:
    """The same from a document that is no XML, by a pattern; it is an index if it says so before its first entry."""
    text, index = b"", None
    for chunk in plain(chunks):
        text += chunk
        end = 0
        for m in LOC.finditer(text):
            if index is None:
                index = b"<sitemapindex" in text[: m.start()]
                yield index, ""
            raw = m[1].decode("utf-8", "replace")
            end = m.end()
            yield index, CDATA.sub(r"\1", raw)
        text = text[end:]


def located(open_it: Callable[[], Chunks]) -> Iterator[tuple[bool, str]]:
    """What strict gives; from where a document stops being XML, what lenient gives."""
    n = 0
    try:
        for x in strict(open_it()):
            n += 1
            yield x
    except ElementTree.ParseError:
        for k, x in enumerate(lenient(open_it())):
            if k >= n:
                yield x


def entries(open_it: Callable[[], Chunks], timeout: float, known: set[str] | None = None) -> Iterator[str]:
    """The urls of a sitemap, cleaned; of an index those of its sitemaps, each read once."""
    known = set() if known is None else known
    for index, text in located(open_it):
        url = clean(text)
        if not index and url:
            yield url
        elif url and url not in known:
            known.add(url)
            yield from entries(lambda url=url: live(url, timeout), timeout, known)


class SitemapSource(DataSource):
    """part, at and url of the entries of live sitemaps. Options: urls (split by blanks), timeout.

    A sitemap is a partition, also one that a given index lists; indexes within indexes are followed by the task.
    """

    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def schema(self) -> str:
        return "part long, at long, url string"

    def reader(self, schema) -> SitemapReader:
        return SitemapReader(self.options)


class SitemapReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.timeout = options["urls"].split(), float(options.get("timeout", 30))

    def partitions(self) -> list[InputPartition]:
        """Of a given url only the beginning is read here, unless it is an index."""
        found = []
        for url in self.urls:
            told = located(lambda url=url: live(url, self.timeout))
            if next(told, (False, ""))[0]:
                found += dict.fromkeys(x for _, text in told if (x := clean(text)))
            else:
                found.append(url)
            told.close()
        return [InputPartition((k, url)) for k, url in enumerate(found)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int, str]]:
        if partition.value:
            part, url = partition.value
            for at, x in enumerate(entries(lambda: live(url, self.timeout), self.timeout, {url})):
                yield part, at, x


def saved(spark: SparkSession, path: str, timeout: float) -> DataFrame:
    """at and url of the entries of a file on any file system that Spark reads; live sitemaps that it lists are followed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                urls = list(entries(lambda content=content: [bytes(content)], timeout))
                yield pd.DataFrame({"at": range(len(urls)), "url": urls}).astype({"at": "int64", "url": "object"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "at long, url string")


def sitemap_urls(spark: SparkSession, *paths: str, timeout: float = 30.0) -> DataFrame:
    """url and pos of the entries of sitemaps, urls or files, in the order of sitemaps and entries; what is listed twice is there twice."""
    spark.dataSource.register(SitemapSource)
    parts = []
    for k, path in enumerate(paths):
        if re.match("(?i)https?://", path):
            # Live ones in a row are one scan.
            if parts and parts[-1][1] is not None:
                parts[-1][1].append(path)
            else:
                parts.append((k, [path]))
        else:
            parts.append((k, None))
    whole = None
    for k, urls in parts:
        if urls:
            one = spark.read.format("sitemap").options(urls=" ".join(urls), timeout=str(timeout)).load()
        else:
            one = saved(spark, paths[k], timeout).withColumn("part", F.lit(0).cast("long"))
        # A given sitemap's place counts first, then the place of a sitemap that an index among them lists.
        one = one.select("url", (F.lit(k * MAPS * PER_MAP) + F.col("part") * PER_MAP + F.col("at")).alias("pos"))
        whole = one if whole is None else whole.union(one)
    return whole
