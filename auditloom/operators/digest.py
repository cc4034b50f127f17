"""Issues: parsing their bodies, upgrading old findings, days, groups of corrections, and what to write back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import contains_any, iso_timestamp, local_day_start, strip
from ..schema import FINDINGS
from .numbering import numbered, placed

ISSUE_PREFIX = "[Report audit] Glaring errors detected:"
DIGEST_TITLE = "[Report audit] Open correction digest"

# The lines of an issue body.
METADATA = {"report_title": "- Report: ", "report_url": "- URL: ", "listed_date": "- Listed date: ", "page_publish_date": "- Page publish date: "}
MISSING = {"report_title": "Unknown report", "report_url": "", "listed_date": "unknown", "page_publish_date": "unknown"}
MODES = {
    "summary": ["Dumbed-down version for upload team:", "Uploader summary:"],
    "instruction": ["Correction instruction:", "Copy-paste fix for upload team:"],
    "evidence": ["Evidence:"],
}
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
HEADING = r"^(.*?) \((.+), ([^,]+), confidence ([0-9.]+)\)$"


def report_issues(issues: DataFrame, prefix: str = ISSUE_PREFIX) -> DataFrame:
    """Issues about reports: no pull requests, no digest."""
    return issues.filter(F.col("pull_request").isNull() & F.col("title").startswith(prefix) & (F.col("title") != DIGEST_TITLE))


def after(line: Column, mark: str) -> Column:
    return strip(F.substring(line, F.lit(len(mark) + 1), F.length(line)))


def is_metadata(line: Column) -> Column:
    found = F.lit(False)
    for mark in METADATA.values():
        found = found | line.startswith(mark)
    return found


def read_section(section: Column) -> Column:
    """Explanation, summary, instruction and evidence out of a section's lines, read one after the other.

    A mark sets the mode that bullets are read in, until a blank line or another mark; lines of metadata are skipped.
    """
    text = F.lit(None).cast("string")
    zero = F.struct(F.lit("none").alias("mode"), text.alias("explanation"), text.alias("summary"), text.alias("instruction"), F.array().cast("array<string>").alias("evidence"))
    marks = F.create_map(F.lit(""), F.lit("none"), *(F.lit(x) for mode, own in MODES.items() for mark in own for x in (mark, mode)))

    def read(state: Column, line: Column) -> Column:
        mode, bullet = state["mode"], line.startswith("- ")
        in_mode = lambda name: F.when(bullet & (mode == name), after(line, "- "))
        plain = F.when(~(bullet & (mode != "none")), line)
        read_line = F.struct(
            mode.alias("mode"),
            F.coalesce(state["explanation"], plain).alias("explanation"),
            F.coalesce(in_mode("summary"), state["summary"]).alias("summary"),
            F.coalesce(in_mode("instruction"), state["instruction"]).alias("instruction"),
            F.when(bullet & (mode == "evidence"), F.concat(state["evidence"], F.array(after(line, "- ")))).otherwise(state["evidence"]).alias("evidence"),
        )
        return F.when(is_metadata(line), state).when(marks[line].isNotNull(), state.withField("mode", marks[line])).otherwise(read_line)

    return F.aggregate(section, zero, read)


def read_finding(heading: Column, parts: Column) -> Column:
    known = heading.rlike(HEADING)
    named = lambda n, other: F.when(known, F.regexp_extract(heading, HEADING, n)).otherwise(other)
    given = lambda name: F.coalesce(parts[name], F.lit(""))
    return F.struct(
        named(2, F.lit("unknown")).alias("category"),
        strip(named(1, heading)).alias("title"),
        given("explanation").alias("explanation"),
        given("summary").alias("uploader_summary"),
        given("instruction").alias("correction_instruction"),
        F.coalesce(F.when(known, F.regexp_extract(heading, HEADING, 4).try_cast("double")), F.lit(0.0)).alias("confidence"),
        named(3, F.lit("unknown")).alias("source"),
        parts["evidence"].alias("evidence"),
    )


def parse_bodies(issues: DataFrame) -> DataFrame:
    """Adds report_title, report_url, listed_date, page_publish_date and findings, read from the body, row by row."""
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), LINE_END), strip)
    rows = issues.withColumn("_lines", lines)
    is_heading = lambda x: x.startswith("### ")
    places = F.filter(F.transform("_lines", lambda x, i: F.when(is_heading(x), i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("_heads", places)
    # A section reaches to the next heading, the last one to the end.
    end = lambda k: F.coalesce(F.get("_heads", k + 1), F.size("_lines") + 1)
    section = lambda at, k: F.struct(after(F.get("_lines", at - 1), "### ").alias("heading"), read_section(F.slice("_lines", at + 1, end(k) - at - 1)).alias("parts"))
    rows = rows.withColumn("_sections", F.transform("_heads", section))
    last = lambda mark: F.get(F.reverse(F.filter("_lines", lambda x: x.startswith(mark))), F.lit(0))
    metadata = {name: F.coalesce(after(last(mark), mark), F.lit(MISSING[name])) for name, mark in METADATA.items()}
    return rows.withColumns(metadata | {"findings": F.transform("_sections", lambda x: read_finding(x["heading"], x["parts"])).cast(FINDINGS)}).drop("_lines", "_heads", "_sections")


# Words of old findings, in order, and the texts that stand in for what they lack.
NUMBER_WORDS = ["cagr", "market size", "market value", "forecast", "million", "billion", "numeric"]
PART_WORDS = ["segment", "segmentation", "type", "application", "end use"]
SUMMARIES = [
    (NUMBER_WORDS, "The market numbers on this page do not match and need correction before upload."),
    (["company", "player", "brand", "merged", "acquisition", "partnership", "launch"], "A company name or company development on this page looks incorrect and needs correction."),
    (PART_WORDS, "The segment list on this page looks incorrect and needs to be aligned with the correct market definition."),
    ([], "This sentence on the page looks wrong and needs correction before upload."),
]
INSTRUCTIONS = [
    (NUMBER_WORDS, "Please verify the market values, CAGR, forecast year, and million or billion unit labels, then update the affected sentence so all numbers match the approved source."),
    (["company", "player", "brand", "merged"], "Please replace the incorrect company name or merged-company reference with the verified company name everywhere it appears in the affected sentence."),
    (["acquisition", "partnership", "launch", "announced", "development"], "Please remove or replace the unverified company development with a verified company update from a reliable public source."),
    (PART_WORDS, "Please replace the incorrect segment list with the verified segmentation for this market and remove any pasted labels that do not belong."),
    ([], "Please review the affected sentence and replace it with the verified wording from the approved source."),
]


def by_words(text: Column, cases: list[tuple[list[str], str]]) -> Column:
    """The text of the first case one of whose words occurs; that of the case without words else."""
    return F.coalesce(*(F.when(contains_any(text, words), value) if words else F.lit(value) for words, value in cases))


def upgraded(x: Column) -> Column:
    """A finding with a summary, and an instruction that begins with please."""
    text = F.lower(F.concat_ws(" ", x["title"], x["category"], x["explanation"]))
    summary, instruction = strip(x["uploader_summary"]), strip(x["correction_instruction"])
    x = x.withField("uploader_summary", F.coalesce(F.nullif(summary, F.lit("")), by_words(text, SUMMARIES)))
    return x.withField("correction_instruction", F.when(F.lower(instruction).startswith("please"), instruction).otherwise(by_words(text, INSTRUCTIONS)))


def upgrade(issues: DataFrame) -> DataFrame:
    return issues.withColumn("findings", F.transform("findings", upgraded))


def of_day(issues: DataFrame, day: Column, zone: str, created: str = "created_at") -> DataFrame:
    """Issues created on a calendar day of a time zone: from its midnight up to the next one, which is not always 24 hours."""
    at = F.col(created) if dict(issues.dtypes)[created] != "string" else iso_timestamp(F.col(created))
    return issues.filter((at >= local_day_start(day, zone)) & (at < local_day_start(F.date_add(day, 1), zone)))


def group_key(instruction: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(strip(instruction), F.lit("")), strip(title))


def same_finding(x: Column) -> list[Column]:
    """What findings that count once agree in."""
    return [F.col("report_url"), x["title"], strip(x["correction_instruction"]), F.array_join(x["evidence"], "||")]


def group_sizes(issues: DataFrame) -> DataFrame:
    """key and size of every group. Which of the findings that agree is the first plays no part, so that they are told apart without being sorted."""
    one = issues.select("report_url", F.explode("findings").alias("finding"))
    key = group_key(F.col("finding.correction_instruction"), F.col("finding.title"))
    same = one.select(key.alias("key"), *(x.alias(f"_same{k}") for k, x in enumerate(same_finding(F.col("finding"))))).distinct()
    return same.groupBy("key").agg(F.count("*").alias("size"))


def unique_findings(issues: DataFrame, dealt_over: int | None = None) -> DataFrame:
    """A row for each finding with its group's key. Of findings that agree in report url, title, instruction and evidence only the first, by report title, url and issue url, stays."""
    one = issues.select("report_title", "report_url", "html_url", F.col("title").alias("issue_title"), F.posexplode("findings").alias("at", "finding"))
    one = one.withColumn("key", group_key(F.col("finding.correction_instruction"), F.col("finding.title")))
    same = same_finding(F.col("finding"))
    one = one.repartition(dealt_over, *same) if dealt_over else one
    return one.withColumn("_k", F.row_number().over(Window.partitionBy(*same).orderBy(*member_order()))).filter("_k = 1").drop("_k")


def member_order() -> list[Column]:
    return [F.lower("report_title"), F.col("report_url"), F.col("html_url"), F.col("at")]


def digest_members(issues: DataFrame, dealt_over: int | None = None) -> DataFrame:
    """A row for each finding of the digest with its group's key and number and its own place within the group. Groups are numbered by their key.

    dealt_over is how many tasks findings are dealt over; without it Spark's own number holds.
    """
    kept = unique_findings(issues, dealt_over).withColumn("_title", F.lower("report_title"))
    return placed(kept, "key", ["_title", "report_url", "html_url", "at"], "number", "place", dealt_over).drop("_title")


def digest_groups(issues: DataFrame) -> DataFrame:
    """key, number and size of every group, and on each row the number of groups and of findings in all."""
    grouped = group_sizes(issues)
    totals = grouped.agg(F.count("*").alias("groups"), F.sum("size").alias("findings"))
    return numbered(grouped, "key", "number").join(F.broadcast(totals)).select("key", "number", "size", "groups", "findings")


def digest_counts(issues: DataFrame) -> DataFrame:
    """issues (all, with or without findings), groups and findings."""
    groups = group_sizes(issues).agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("findings"))
    return issues.agg(F.count("*").alias("issues")).join(F.broadcast(groups))


def day_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count("*").alias("reports"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).cast("long").alias("findings"))


def missing_issues(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New issues whose title no open issue has."""
    held = existing.filter("pull_request is null and state = 'open'").select("title").distinct()
    return new.join(held, "title", "left_anti")


def upsert_actions(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """title, body and action: create if no open issue has the title, update if the first that has it differs, else noop."""
    held = existing.filter("pull_request is null and state = 'open'").groupBy("title").agg(F.min_by(F.struct("number", F.coalesce("body", F.lit("")).alias("body")), "number").alias("held"))
    action = F.when(F.col("held").isNull(), "create").when(F.col("held.body") != F.col("body"), "update").otherwise("noop")
    return wanted.join(held, "title", "left").select("title", "body", F.col("held.number").alias("number"), action.alias("action"))


def changed(issues: DataFrame, rendered: str = "rendered") -> DataFrame:
    """Issues whose body would become another one."""
    # A filter would be pushed below the columns that it compares, and parse and write every body once more for it.
    numbered_rows = issues.withColumn("_row", F.monotonically_increasing_id())
    return numbered_rows.filter((F.col("_row") >= 0) & (F.col(rendered) != F.coalesce("body", F.lit("")))).drop("_row")
