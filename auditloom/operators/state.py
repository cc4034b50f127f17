"""The seen set of an incremental poll: which cards are admitted, and what is remembered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .titles import first_per

MAX_NEW = 25
MAX_SEEN = 5000


@dataclass(frozen=True)
class Poll:
    """How one poll goes: cards admitted at most, whether the first one audits, or a url audited whatever was seen."""

    max_new: int = MAX_NEW
    audit_initial: bool = False
    force_url: str | None = None


def unseen(cards: DataFrame, seen: DataFrame) -> DataFrame:
    return cards.join(seen.select("url").distinct(), "url", "left_anti")


def feed_cards(cards: DataFrame) -> DataFrame:
    """Cards with a url, of each url the first."""
    return first_per(cards.filter("url <> ''"), "url")


def admitted(cards: DataFrame, seen: DataFrame, bootstrapped: bool, poll: Poll = Poll()) -> DataFrame:
    """The cards to audit, in feed order: none on the first poll, which only fills the seen set; else the first unseen ones."""
    if poll.force_url is not None:
        spark = cards.sparkSession
        return spark.createDataFrame([("", poll.force_url, "", "", 0)], "title string, url string, summary string, published_on string, pos long").select(*(c for c in cards.columns if c in ("title", "url", "summary", "published_on", "pos")))
    own = feed_cards(cards)
    if poll.audit_initial:
        return own.orderBy("pos").limit(poll.max_new)
    return unseen(own, seen).orderBy("pos").limit(poll.max_new) if bootstrapped else own.limit(0)


def remembered(cards: DataFrame, chosen: DataFrame, seen: DataFrame, bootstrapped: bool, poll: Poll = Poll()) -> DataFrame:
    """The seen set after a poll. Cards beyond the cap are not in it, so that the next poll takes them up."""
    if poll.force_url is not None:
        return seen.select("url")
    new = chosen if bootstrapped or poll.audit_initial else feed_cards(cards)
    return seen.select("url").union(new.select("url")).distinct()


def evicted(seen: DataFrame, keep: int = MAX_SEEN) -> DataFrame:
    """The greatest urls in code point order; age doesn't matter."""
    return seen.select("url").distinct().orderBy(F.desc("url")).limit(keep)
