"""Report pages from HTML.

``exact`` reads a tree of elements in an Arrow function. ``native`` uses
patterns alone and stays in the JVM: it closes paragraphs at the next paragraph
tag, knows few character references, and takes no JSON-LD inside of comments into account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import page_fields
from ..functions.text import contains_any, squeeze
from ..schema import REPORT_PAGE

# What makes a paragraph one of the summary or of the competition, and how many are kept.
SUMMARY_WORDS = ["market", "forecast", "demand", "analysis"]
COMPETITIVE_WORDS = ["key players", "competitive landscape", "providers have", "acquiring", "partnerships"]
LEAST_LENGTH, SUMMARIES, COMPETITIVE, FAQS = 50, 8, 6, 8
#: Character references that native reading decodes; the ampersand last, so that nothing is decoded twice.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def paragraphs_with(paragraphs: Column, words: list[str], n: int) -> Column:
    return F.slice(F.filter(paragraphs, lambda x: contains_any(F.lower(x), words)), 1, n)


def long_paragraphs(paragraphs: Column) -> Column:
    return F.filter(paragraphs, lambda x: F.length(x) >= LEAST_LENGTH)


def plain(markup: Column) -> Column:
    """Text of a piece of markup: tags become blanks, references are decoded, white space is squeezed."""
    text = F.regexp_replace(markup, "<[^>]*>", " ")
    for reference, character in REFERENCES.items():
        text = F.replace(text, F.lit(reference), F.lit(character))
    return squeeze(text)


def inner(page: Column, name: str) -> Column:
    return plain(F.regexp_extract(page, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1))


def faq_and_date(page: Column) -> tuple[Column, Column]:
    """From the scripts of JSON-LD, lists and graphs as deep as they go: question and answer pairs, and the first date."""
    raw = F.regexp_extract_all(page, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script"""), F.lit(1))
    values = F.filter(F.transform(raw, lambda x: F.try_parse_json(plain(x))), lambda x: x.isNotNull())
    is_kind = lambda x, kind: F.schema_of_variant(x).startswith(kind)
    members = lambda x: F.try_variant_get(x, "$", "array<variant>")
    opened = lambda xs: F.flatten(F.transform(xs, lambda x: F.coalesce(members(x), F.array(x))))
    # Lists are opened until none is left: at most as often as brackets open.
    depth = F.array_max(F.concat(F.array(F.lit(0)), F.transform(raw, lambda x: F.length(x) - F.length(F.replace(x, F.lit("["), F.lit(""))))))
    items = F.reduce(F.sequence(F.lit(0), depth), values, lambda xs, _: F.when(F.exists(xs, lambda x: is_kind(x, "ARRAY")), opened(xs)).otherwise(xs))
    # Of a graph's members only those that are objects count, and they aren't opened.
    graph = lambda x: F.filter(F.try_variant_get(x, "$['@graph']", "array<variant>"), lambda y: is_kind(y, "OBJECT"))
    items = F.flatten(F.transform(items, lambda x: F.coalesce(graph(x), F.array(x))))
    dates = F.filter(F.transform(items, lambda x: squeeze(F.coalesce(F.try_variant_get(x, "$.datePublished", "string"), F.lit("")))), lambda x: x != "")
    pages = F.filter(items, lambda x: F.try_variant_get(x, "$['@type']", "string") == "FAQPage")
    entities = F.flatten(F.transform(pages, lambda x: F.coalesce(F.try_variant_get(x, "$.mainEntity", "array<variant>"), F.array().cast("array<variant>"))))
    text = lambda x, path: squeeze(F.coalesce(F.try_variant_get(x, path, "string"), F.lit("")))
    pairs = F.transform(entities, lambda x: F.struct(text(x, "$.name").alias("question"), text(x, "$.acceptedAnswer.text").alias("answer")))
    return F.slice(F.filter(pairs, lambda x: (x["question"] != "") & (x["answer"] != "")), 1, FAQS), F.coalesce(F.get(dates, F.lit(0)), F.lit(""))


def native_fields(page: Column) -> list[Column]:
    meta = F.regexp_extract(page, r"""(?is)<meta\s[^>]*name=["']description["'][^>]*>""", 0)
    paragraphs = F.filter(F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p\s*>|<p[\s>]|</(?:article|div|body)|$)"), F.lit(1)), plain), lambda x: x != "")
    faq, date = faq_and_date(page)
    return [inner(page, "title").alias("page_title"), inner(page, "h1").alias("h1"), inner(page, "h2").alias("lead_summary"), plain(F.regexp_extract(meta, r"""(?is)content=(["'])(.*?)\1""", 2)).alias("meta_description"), paragraphs.alias("paragraphs"), faq.alias("faq_items"), date.alias("publish_date")]


def report_pages(pages: DataFrame, exact: bool = True, html: str = "html") -> DataFrame:
    """Rows of REPORT_PAGE from a url, its html and, where there are, the card's title, summary and published_on."""
    page = F.coalesce(html, F.lit(""))
    of_card = [(F.coalesce(F.col(x), F.lit("")) if x in pages.columns else F.lit("")).alias(f"card_{x}") for x in ("title", "summary", "published_on")]
    if exact:
        read = pages.select("url", *of_card, page_fields(page).alias("_read")).select("url", "card_title", "card_summary", "card_published_on", "_read.*")
    else:
        read = pages.select("url", *of_card, *native_fields(page))
    whole = long_paragraphs(F.col("paragraphs"))
    read = read.withColumn("summary_paragraphs", paragraphs_with(whole, SUMMARY_WORDS, SUMMARIES)).withColumn("competitive_paragraphs", paragraphs_with(whole, COMPETITIVE_WORDS, COMPETITIVE))
    return read.select(*REPORT_PAGE.names)
