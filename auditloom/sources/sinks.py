"""Where results go: versioned state, run and summary files, a tracker, mail."""

from __future__ import annotations

import datetime as dt
import json
import os
import smtplib
import uuid
from email.message import EmailMessage

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.render import run_entries, run_sections
from ..operators.state import evicted
from ..schema import SEEN
from .http import register
from .versions import Versions


def save_seen(spark: SparkSession, seen: DataFrame, path: str, keep: int = 5000) -> None:
    """Adds to the seen set, as the version after the last one, which may be another poll's. If one more comes first, its urls are taken in, and the version after is tried."""
    versions = Versions(spark, path)
    seen = spark.createDataFrame(evicted(seen, keep).collect(), SEEN)  # keep urls at most
    while True:
        base, whole = versions.last(), seen
        if base:
            whole = whole.union(spark.read.schema(SEEN).parquet(f"{path}/{versions.read(base)['table']}"))
        table = f"urls-{uuid.uuid4().hex}"
        evicted(whole, keep).write.parquet(f"{path}/{table}")
        if versions.claim(base + 1, {"table": table, "bootstrapped": True}):
            versions.tidy()
            return
        versions.drop(table)


def write_text(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def write_run(audited: DataFrame, folder: str, order: list[str] | None = None) -> int:
    """The run's JSON and markdown on the driver; a run audits few pages. Gives the number of pages with findings.

    ``order`` has the urls in the order in which they were admitted.
    """
    place = {url: k for k, url in enumerate(order or [])}
    rank = lambda url: (place.get(url, len(place)), url)
    entries = sorted((json.loads(r[0]) for r in run_entries(audited).select(F.to_json(F.struct("*"))).collect()), key=lambda x: rank(x["url"]))
    sections = [r["section"] for r in sorted(run_sections(audited).collect(), key=lambda r: rank(r["url"]))]
    write_text(f"{folder}/latest_run.json", json.dumps(entries, indent=2) + "\n")
    rest = "\n".join(sections) or "No glaring report issues were detected."
    write_text(f"{folder}/latest_run.md", f"# Report audit run summary\n\n{rest}".strip() + "\n")
    return len(entries)


ACTIONS = ("create", "update", "noop")


def write_actions(actions: DataFrame, config: Config, tasks: int = 4, receipt: str | None = None) -> dict[str, int]:
    """Sends creations and updates of issues (title, body, number, action) to the tracker, from a few tasks, each issue once. Gives how many of each were asked for.

    The actions are kept first: they were made from the tracker's issues, which change while they are sent.
    """
    token, repository = config.tracker()
    options = {"base": f"{config.tracker_url}/repos/{repository}/issues", "token": token, "timeout": str(config.request_timeout)}
    register(actions.sparkSession)
    planned = held(actions.select("title", "body", F.col("number").cast("long").alias("number"), "action"))
    counts = {r["action"]: r["count"] for r in planned.groupBy("action").count().collect()}
    if set(counts) - {"noop"}:
        # By title, so that equal titles meet in one task.
        rows = planned.filter("action <> 'noop'").repartition(tasks, "title")
        rows.write.format("tracker_issues").mode("append").options(**options | ({"receipt": receipt} if receipt else {})).save()
    return {x: counts.get(x, 0) for x in ACTIONS}


def held(df: DataFrame) -> DataFrame:
    """The rows as they are now: in the folder of spark.checkpoint.dir if there is one, so that they outlive executors, else in memory and on disks."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def summary_subject(day: dt.date, zone: str, n: int) -> str:
    return f"Report audit daily summary for {day.isoformat()} ({zone}, {n} report issue{'' if n == 1 else 's'})"


def mail(config: Config, day: dt.date, body: str, n: int, connect=None) -> EmailMessage:
    """Sends the summary; raises if an address or the host is missing. ``connect`` stands in for the SMTP classes in tests."""
    for name in ("summary_email_to", "summary_email_from", "smtp_host"):
        if not getattr(config, name):
            raise ValueError(f"{name} is needed to send the daily summary.")
    message = EmailMessage()
    message["Subject"] = summary_subject(day, config.summary_timezone, n)
    message["From"], message["To"] = config.summary_email_from, config.summary_email_to
    message.set_content(body)
    make = connect or (smtplib.SMTP_SSL if config.smtp_use_ssl else smtplib.SMTP)
    with make(config.smtp_host, config.smtp_port, timeout=30) as smtp:
        if not config.smtp_use_ssl:
            smtp.ehlo()
            if config.smtp_starttls:
                smtp.starttls()
                smtp.ehlo()
        if config.smtp_username:
            smtp.login(config.smtp_username, config.smtp_password or "")
        smtp.send_message(message)
    return message
