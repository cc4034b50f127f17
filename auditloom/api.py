"""The engine's three jobs as functions from tables to tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.digest import changed, missing_issues, of_day, parse_bodies, report_issues, upgrade, upsert_actions
from .operators.pages import report_pages
from .operators.render import daily_summary, digest_body, rewritten
from .operators.review import with_reviews
from .operators.rules import rule_findings


def audit(pages: DataFrame, index: DataFrame | None = None, reviews: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Report pages with all their findings, from html (url, html, and the card's columns), the title index and recorded reviews (url, response)."""
    return with_reviews(rule_findings(report_pages(pages, exact), index), reviews)


def backfill(issues: DataFrame) -> DataFrame:
    """Open report issues whose body would be written otherwise today, with the new body as ``rendered``."""
    held = report_issues(issues.filter("state = 'open'"))
    return changed(rewritten(upgrade(parse_bodies(held))))


def backfill_actions(issues: DataFrame) -> DataFrame:
    """The backfill as updates for a tracker: title, body, number and action."""
    return backfill(issues).select("title", F.col("rendered").alias("body"), "number", F.lit("update").alias("action"))


def creations(new: DataFrame, issues: DataFrame) -> DataFrame:
    """New issues (title, body) that no open one has, as creations for a tracker."""
    return missing_issues(new, issues).select("title", "body", F.lit(None).cast("long").alias("number"), F.lit("create").alias("action"))


def digest(issues: DataFrame) -> DataFrame:
    """One row with the digest of the open report issues, as the backfill leaves them."""
    return digest_body(upgrade(parse_bodies(report_issues(issues.filter("state = 'open'")))))


def digest_action(issues: DataFrame, title: str) -> DataFrame:
    """What the tracker's digest issue needs: create, update or noop."""
    return upsert_actions(digest(issues).select(F.lit(title).alias("title"), "body"), issues)


def daily(issues: DataFrame, day: dt.date, zone: str = "Asia/Calcutta", repository: str = "") -> DataFrame:
    """One row with the summary of the report issues opened on a day, open or closed."""
    own = of_day(report_issues(issues), F.lit(day), zone)
    return daily_summary(parse_bodies(own), F.lit(day), zone, repository)
