"""Commands: audit a feed's new reports, bring the digest up to date, summarize a day. Each runs in the session it is given or makes one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .config import Config, follow_arguments, poll_arguments, summary_arguments
from .functions.text import local_today
from .operators.digest import DIGEST_TITLE
from .operators.review import prompts, reviewer, reviews
from .operators.state import Poll
from .sources import http, sinks
from .sources.tables import cached_index, cards_of, fetched_pages, sitemap_urls
from .streaming.poll import audit_stream, poll
from .streaming.state import with_state


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def fresh_audit(spark: SparkSession, index_path: str, sitemaps: list[str], make_reviewer: Callable | None = None, timeout: float = 30.0, answers_path: str = "", settings: str = "") -> Callable[[DataFrame], DataFrame]:
    """An audit of cards for a poll or for every batch of a stream: the title index is looked up each time, and made anew once it is too old.

    A reviewer's answers are kept at ``answers_path``, by what was asked. What the rules
    found is held, since pages are fetched for it.
    """

    def audit(cards: DataFrame) -> DataFrame:
        index = cached_index(spark, index_path, lambda: sitemap_urls(spark, *sitemaps, timeout=timeout)) if sitemaps else None
        found = api.audit(fetched_pages(cards, timeout), index)
        if make_reviewer is None:
            return found
        found = sinks.held(found)
        return api.with_reviews(found, reviews(prompts(found), answers_path, make_reviewer, settings))

    return audit


def tracker_issues(spark: SparkSession, config: Config, state: str = "all") -> DataFrame:
    """The tracker's issues; filters on state and created are done by the tracker as far as it can."""
    token, repository = config.tracker()
    http.register(spark)
    options = {"base": f"{config.tracker_url}/repos/{repository}/issues", "state": state, "token": token, "timeout": str(config.request_timeout)}
    return spark.read.format("tracker_issues").options(**options).load()


def poll_command(argv: list[str] | None = None, env: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> str:
    """Audits what is new in the feed; gives the line of status that it prints."""
    args, config, spark = poll_arguments(argv), Config.from_env(env), spark or session()
    http.register(spark)
    feed = spark.read.format("report_feed").options(url=config.feed_url, pages=str(args.pages), records=str(args.records_per_page), timeout=str(config.request_timeout))
    audit = fresh_audit(spark, f"{args.state_path}/titles", config.sitemap_list(), reviewer(config), config.request_timeout, f"{args.state_path}/answers", config.reviewer_model)
    publish = None
    if config.tracker_token and config.tracker_repository:
        publish = lambda new: sinks.write_actions(api.creations(new, tracker_issues(spark, config).filter("state = 'open'")), config)
    done = poll(spark, cards_of(feed.load()), args.state_path, audit, args.artifacts_path, Poll(max_new=args.max_new, audit_initial=args.audit_initial, force_url=args.force_url), args.dry_run, publish)
    line = "Remembered the reports that are there; nothing was audited." if done.bootstrapped_now else f"Audited {done.audited} new reports, {done.with_issues} with findings."
    print(line)
    return line


def follow_command(argv: list[str] | None = None, env: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> str:
    """Audits the feed's new cards as a stream: looks every so many seconds, or once for what is new since the last run."""
    args, config, spark = follow_arguments(argv), Config.from_env(env), with_state(spark or session())
    http.register(spark)
    options = {"url": config.feed_url, "pages": str(args.pages), "records": str(args.records_per_page), "timeout": str(config.request_timeout), "log": f"{args.state_path}/looks"}
    cards = spark.readStream.format("report_cards").options(**options).load()
    audit = fresh_audit(spark, f"{args.state_path}/titles", config.sitemap_list(), reviewer(config), config.request_timeout, f"{args.state_path}/answers", config.reviewer_model)
    publish = None
    if config.tracker_token and config.tracker_repository and not args.dry_run:
        publish = lambda new: sinks.write_actions(api.creations(new, tracker_issues(spark, config).filter("state = 'open'")), config)
    poll_ = Poll(max_new=args.max_new, audit_initial=args.audit_initial)
    writer = audit_stream(cards, audit, args.artifacts_path, poll_, publish, again=args.every or 0).option("checkpointLocation", f"{args.state_path}/stream")
    query = writer.trigger(**({"processingTime": f"{args.every} seconds"} if args.every else {"availableNow": True})).start()
    query.awaitTermination()
    told = query.lastProgress
    line = f"Read {told['numInputRows']} new cards with the last batch." if told else "Nothing is new in the feed."
    print(line)
    return line


def digest_command(argv: list[str] | None = None, env: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> str:
    """Rewrites open issues of old forms, then creates or updates the digest issue."""
    config, spark = Config.from_env(env), spark or session()
    # Read once: the digest upgrades what it reads, so it needs no second look at the rewritten issues.
    issues = sinks.held(tracker_issues(spark, config).filter("state = 'open'"))
    old = sinks.write_actions(api.backfill_actions(issues), config)
    done = sinks.write_actions(api.digest_action(issues, DIGEST_TITLE), config)
    line = f"Rewrote {old['update']} issues; digest {next((k for k, n in done.items() if n), 'noop')}."
    print(line)
    return line


def summary_command(argv: list[str] | None = None, env: Mapping[str, str] | None = None, spark: SparkSession | None = None, connect=None) -> str:
    """Writes the summary of a day, today's in the configured zone if none is given, and mails it unless it is a dry run."""
    args, config, spark = summary_arguments(argv), Config.from_env(env), spark or session()
    day = dt.date.fromisoformat(args.date) if args.date else local_today(config.summary_timezone)
    start, end = (dt.datetime.combine(day + dt.timedelta(days=k), dt.time(), ZoneInfo(config.summary_timezone)).astimezone(dt.UTC) for k in (0, 1))
    issues = sinks.held(tracker_issues(spark, config).filter((F.col("created") >= F.lit(start)) & (F.col("created") < F.lit(end))))
    body = api.daily(issues, day, config.summary_timezone, config.tracker_repository or "").first()["body"]
    sinks.write_text(args.output_path, body)
    n = api.of_day(api.report_issues(issues), F.lit(day), config.summary_timezone).count()
    if not args.dry_run:
        sinks.mail(config, day, body, n, connect)
    line = f"Summary of {day.isoformat()}: {n} report issues, written to {args.output_path}{'' if args.dry_run else ' and mailed'}."
    print(line)
    return line
