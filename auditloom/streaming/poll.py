"""Polls: one by one, or as the batches of a stream of cards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.render import new_issues
from ..operators.state import Poll, admitted, remembered
from ..sources.sinks import held, save_seen, write_run
from ..sources.tables import seen_state
from .state import CARD, admissions


@dataclass
class Outcome:
    bootstrapped_now: bool
    audited: int
    with_issues: int


def poll(spark: SparkSession, cards: DataFrame, state_path: str, audit: Callable[[DataFrame], DataFrame], artifacts: str, settings: Poll = Poll(), dry_run: bool = False, publish: Callable[[DataFrame], None] | None = None) -> Outcome:
    """One poll: choose cards, audit them, write what was found, then remember them.

    Sinks come before the state, so that a failure repeats the poll and loses
    nothing; publishing has to be idempotent. A dry run leaves the state alone.
    The admitted cards are materialized before they are audited, so nothing is
    fetched for a card that is not admitted.
    """
    known, seen = seen_state(spark, state_path)
    chosen = admitted(cards, seen, known, settings)
    first = not known and not settings.audit_initial and settings.force_url is None
    rows = chosen.collect()  # at most max_new cards
    chosen = spark.createDataFrame(rows, chosen.schema)
    audited = audit(chosen).persist()
    try:
        n = audited.count()
        found = write_run(audited, artifacts, [r["url"] for r in rows])
        if publish and not dry_run and found:
            publish(new_issues(audited))
        if not dry_run and settings.force_url is None:
            save_seen(spark, remembered(cards, chosen, seen, known, settings), state_path)
    finally:
        audited.unpersist()
    return Outcome(first, n, found)


def poll_stream(cards: DataFrame, state_path: str, audit: Callable[[DataFrame], DataFrame], artifacts: str, settings: Poll = Poll(), publish: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """The same for every batch of a stream of cards. A batch that runs again finds its cards seen, and publishing checks titles."""

    def batch(rows: DataFrame, number: int) -> None:
        poll(rows.sparkSession, rows, state_path, audit, f"{artifacts}/{number}", settings, publish=publish)

    return cards.writeStream.foreachBatch(batch)


def audit_stream(cards: DataFrame, audit: Callable[[DataFrame], DataFrame], artifacts: str, settings: Poll = Poll(), publish: Callable[[DataFrame], None] | None = None, again: float = 0) -> DataStreamWriter:
    """Audits a stream of cards whose admission is the stream's own state: no seen set beside it, and nothing is read twice.

    A batch that runs again has the same cards, writes the same files, and publishes
    what the tracker doesn't have yet. Use with_state() before it starts.
    """

    def batch(rows: DataFrame, number: int) -> None:
        admitted = rows.select(*CARD).collect()  # at most max_new cards
        if not admitted:
            return
        audited = held(audit(rows.sparkSession.createDataFrame(admitted, rows.select(*CARD).schema)))
        if write_run(audited, f"{artifacts}/{number}", [r["url"] for r in admitted]) and publish:
            publish(new_issues(audited))

    return admissions(cards, settings, again=again).writeStream.foreachBatch(batch)


def day_counts(issues: DataFrame, zone: str, created: str = "created_at", delay: str = "1 day") -> DataFrame:
    """Issues by local calendar day, of a batch or a stream. Days are cut by date, since they are not all 24 hours long."""
    day = F.to_date(F.from_utc_timestamp(F.col(created), zone))
    rows = issues.withWatermark(created, delay) if issues.isStreaming else issues
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("issues"))
