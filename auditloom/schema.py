"""Schemas of the engine's rows. Missing text is the empty string, not null."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TEXT, LONG, TEXTS = T.StringType(), T.LongType(), T.ArrayType(T.StringType())

CARD = _of(("title", TEXT), ("url", TEXT), ("summary", TEXT), ("published_on", TEXT), ("pos", LONG))

FAQ = T.ArrayType(_of(("question", TEXT), ("answer", TEXT)))

PAGE_TEXT = [(x, TEXT) for x in ("url", "card_title", "card_summary", "card_published_on", "page_title", "h1", "meta_description", "lead_summary", "publish_date")]
REPORT_PAGE = _of(*PAGE_TEXT, ("summary_paragraphs", TEXTS), ("competitive_paragraphs", TEXTS), ("faq_items", FAQ))

FINDING = _of(
    ("category", TEXT),
    ("title", TEXT),
    ("explanation", TEXT),
    ("uploader_summary", TEXT),
    ("correction_instruction", TEXT),
    ("confidence", T.DoubleType()),
    ("source", TEXT),
    ("evidence", TEXTS),
)
FINDINGS = T.ArrayType(FINDING)

INDEXED_TITLE = _of(("url", TEXT), ("title", TEXT), ("normalized_title", TEXT), ("singular_title", TEXT), ("pos", LONG))

#: What a reviewer answers.
REVIEW_ITEM = _of(*[(f.name, f.dataType) for f in FINDING.fields if f.name != "source"])
REVIEW = _of(("should_alert", T.BooleanType()), ("summary", TEXT), ("findings", T.ArrayType(REVIEW_ITEM)))

ISSUE = _of(("number", LONG), ("title", TEXT), ("html_url", TEXT), ("created_at", TEXT), ("body", TEXT), ("state", TEXT), ("pull_request", TEXT))

SEEN = _of(("url", TEXT))
