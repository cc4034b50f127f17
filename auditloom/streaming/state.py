"""What a stream of cards remembers, as Spark's own state: which cards are admitted, and the days of a time zone.

State needs the RocksDB store: spark.sql.streaming.stateStore.providerClass (see ``with_state``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import MAX_SEEN, Poll

CARD = ("title", "url", "summary", "published_on", "pos")
ADMITTED = "feed string, title string, url string, summary string, published_on string, pos long"


def with_state(spark: SparkSession) -> SparkSession:
    """Has the queries that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Admission(StatefulProcessor):
    """Admits a feed's new cards, a few with each batch, by the rules of ``Poll``.

    Of a feed it keeps the urls that it has seen, ``keep`` at most, those that are
    greatest as strings, and the cards beyond a batch's cap, which wait: they come
    after a later batch's own cards, unless that batch holds them again. The first
    batch of a feed fills the seen set and admits nothing, unless the poll audits it.
    With ``again``, cards that wait are admitted so many seconds later even if no
    batch comes; not for streams that are to end (availableNow).
    """

    def __init__(self, poll: Poll = Poll(), keep: int = MAX_SEEN, again: float = 0):
        self.poll, self.keep, self.again = poll, keep, again

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "url string", "at long")
        self.waiting = handle.getMapState("waiting", "url string", "batch long, title string, summary string, published_on string, pos long")
        self.batches = handle.getValueState("batches", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        number = self.batches.get()[0] + 1 if self.batches.exists() else 1
        self.batches.update((number,))
        own: dict[str, Row] = {}
        for x in sorted(rows, key=lambda x: x["pos"]):
            if x["url"]:
                own.setdefault(x["url"], x)
        if number == 1 and not self.poll.audit_initial:
            self.remember(own, number)
            return
        fresh = [u for u in own if self.poll.audit_initial or not self.seen.containsKey((u,))]
        for url in fresh:
            x = own[url]
            # Negative, so that cards of the latest batch come first, those of one batch in feed order.
            self.waiting.updateValue((url,), (-number, x["title"], x["summary"], x["published_on"], x["pos"]))
        yield from self.admit(key, number, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        number = self.batches.get()[0] + 1
        self.batches.update((number,))
        yield from self.admit(key, number, timerValues)

    def admit(self, key, number: int, times) -> Iterator[Row]:
        queue = sorted(((v[0], v[4], u[0], v) for u, v in self.waiting.iterator()), key=lambda x: x[:3])
        chosen = queue[: self.poll.max_new]
        for _, pos, url, (_, title, summary, published_on, _) in chosen:
            self.waiting.removeKey((url,))
            yield Row(feed=key[0], title=title, url=url, summary=summary, published_on=published_on, pos=pos)
        self.remember([url for _, _, url, _ in chosen], number)
        if self.again and len(queue) > len(chosen):
            self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + int(self.again * 1000))

    def remember(self, urls, number: int) -> None:
        for url in urls:
            self.seen.updateValue((url,), (number,))
        held = sorted(u for (u,) in self.seen.keys())
        for url in held[: max(0, len(held) - self.keep)]:
            self.seen.removeKey((url,))

    def close(self) -> None:
        pass


def admissions(cards: DataFrame, poll: Poll = Poll(), keep: int = MAX_SEEN, again: float = 0, feed: Column | None = None) -> DataFrame:
    """feed and the card columns of the admitted cards of a stream, batch by batch. Feeds are apart, in tasks of their own; without ``feed`` all cards are one feed's."""
    rows = cards.select((F.lit("feed") if feed is None else F.coalesce(feed.cast("string"), F.lit(""))).alias("feed"), *CARD)
    # Where there are timers by the clock, batches never end; a stream that is to stop when it has read what is there has none.
    return rows.groupBy("feed").transformWithState(Admission(poll, keep, again), ADMITTED, "append", "processingTime" if again else "none")


def day_end(day: dt.date, zone: str) -> dt.datetime:
    """The midnight at which a day of a zone ends."""
    return dt.datetime.combine(day + dt.timedelta(days=1), dt.time(), ZoneInfo(zone)).astimezone(dt.UTC)


class Days(StatefulProcessor):
    """Counts a day's rows, and tells the count when the watermark passes the day's end, be the day 23, 24 or 25 hours long."""

    def __init__(self, zone: str):
        self.zone = zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.count = handle, handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = sum(1 for _ in rows)
        if self.count.exists():
            n += self.count.get()[0]
        else:
            self.handle.registerTimer(int(day_end(key[0], self.zone).timestamp() * 1000))
        self.count.update((n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n = self.count.get()[0]
        self.count.clear()
        end = day_end(key[0], self.zone)
        start = day_end(key[0] - dt.timedelta(days=1), self.zone)
        yield Row(day=key[0], issues=n, hours=int((end - start).total_seconds() // 3600))

    def close(self) -> None:
        pass


def closed_days(issues: DataFrame, zone: str, created: str = "created", delay: str = "1 hour") -> DataFrame:
    """day, issues and hours of every local day of a stream of issues, once it is over: when the newest row is later than its end by ``delay``.

    Rows that come within the delay count; later ones are left out. Rows without a time are left out.
    """
    at = issues.select(F.col(created).alias("created")).filter("created is not null").withWatermark("created", delay)
    rows = at.withColumn("day", F.to_date(F.from_utc_timestamp("created", zone)))
    return rows.groupBy("day").transformWithState(Days(zone), "day date, issues long, hours int", "append", "eventTime")
