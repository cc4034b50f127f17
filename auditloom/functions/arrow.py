"""Arrow functions for what Spark's own can't express: Unicode folding and exact reading of HTML and JSON-LD."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FAQ, TEXT, TEXTS

SPACE = re.compile(r"\s+")


def clean(text: str) -> str:
    """Character references decoded first, then white space squeezed."""
    return SPACE.sub(" ", html.unescape(text)).strip()


@F.pandas_udf(TEXT)
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def ascii_fold(c: Column) -> Column:
    """Letters without accents and such; what has no ASCII form is dropped. ASCII text doesn't go through Python's hands."""
    return F.coalesce(_fold(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


@F.pandas_udf(TEXT)
def normalize(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: clean(x or ""))


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    """Collects the text below chosen elements; unclosed elements hold what follows, up to their parent's end."""

    def __init__(self, names: set[str]):
        super().__init__(convert_charrefs=True)
        self.names, self.open, self.found = names, [], {x: [] for x in names}
        self.metas: list[dict[str, str | None]] = []
        self.anchors: list[tuple[int, dict]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            self.metas.append(dict(attrs))
        pieces = None
        if tag in self.names:
            pieces = []
            self.found[tag].append((dict(attrs), pieces))
        if tag not in VOID:
            self.open.append((tag, pieces))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        # What stands in a script or style is no text of the elements around it.
        inner = self.open[-1:] if self.open and self.open[-1][0] in ("script", "style") else self.open
        for _, pieces in inner:
            if pieces is not None:
                pieces.append(data)


def joined(pieces: list[str]) -> str:
    """The pieces without white space around them, joined by spaces."""
    return clean(" ".join(x for x in (p.strip() for p in pieces) if x))


def json_ld_items(value: object) -> Iterator[dict]:
    """Of lists every member's items; of a dict its graph's dicts, or itself."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            graph = x.get("@graph")
            yield from (y for y in graph if isinstance(y, dict)) if isinstance(graph, list) else (x,)


def as_text(value: object) -> str:
    return "" if value is None else clean(str(value))


def read_page(page: str | None) -> dict:
    """All that a page's audit needs, read from a tree of its elements."""
    reader = _Reader({"title", "h1", "h2", "p", "script"})
    reader.feed(page or "")
    reader.close()
    texts = {x: [joined(pieces) for _, pieces in reader.found[x]] for x in ("title", "h1", "h2", "p")}
    faq, date = [], ""
    for attributes, pieces in reader.found["script"]:
        if attributes.get("type") != "application/ld+json" or not (raw := clean("".join(pieces))):
            continue
        try:
            value = json.loads(raw)
        except ValueError:
            continue
        for item in json_ld_items(value):
            date = date or as_text(item.get("datePublished"))
            entities = item.get("mainEntity")
            if item.get("@type") != "FAQPage" or not isinstance(entities, list):
                continue
            for entity in (x for x in entities if isinstance(x, dict)):
                answer = entity.get("acceptedAnswer")
                question, reply = as_text(entity.get("name")), as_text(answer.get("text")) if isinstance(answer, dict) else ""
                if question and reply:
                    faq.append({"question": question, "answer": reply})
    first = lambda x: texts[x][0] if texts[x] else ""
    described = next((m.get("content") for m in reader.metas if m.get("name") == "description"), "")
    return {"page_title": first("title"), "h1": first("h1"), "lead_summary": first("h2"), "meta_description": clean(described or ""), "paragraphs": texts["p"], "faq_items": faq[:8], "publish_date": date}


PAGE_FIELDS = T.StructType([*(T.StructField(x, TEXT) for x in ("page_title", "h1", "lead_summary", "meta_description")), T.StructField("paragraphs", TEXTS), T.StructField("faq_items", FAQ), T.StructField("publish_date", TEXT)])


@F.pandas_udf(PAGE_FIELDS)
def page_fields(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(x) for x in pages], columns=PAGE_FIELDS.names)


class _Cards(HTMLParser):
    """Feed markup: per card the first linked heading, the first paragraph of its text box and its date box."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str], str | None]] = []
        self.cards: list[dict] = []

    # Fixed values below: the class names of the feed.
    def inside(self, tag: str, name: str | None = None) -> bool:
        return any(t == tag and (name is None or name in classes) for t, classes, _ in self.open)

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        classes, part = set((attributes.get("class") or "").split()), None
        if tag == "div" and "rep_div" in classes:
            self.cards.append({})
        card = self.cards[-1] if self.cards and (self.inside("div", "rep_div")) else None
        if card is not None:
            if tag == "a" and self.inside("h3") and "href" in attributes and "title" not in card:
                part, card["url"], card["title"] = "title", attributes["href"] or "", []
            elif tag == "p" and self.inside("div", "info_content") and "summary" not in card:
                part, card["summary"] = "summary", []
            elif tag == "div" and "date_box" in classes and "published_on" not in card:
                part, card["published_on"] = "published_on", []
        if tag not in VOID:
            self.open.append((tag, classes, part))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        for _, _, part in self.open:
            if part:
                self.cards[-1][part].append(data)


def read_cards(markup: str | None) -> list[dict]:
    reader = _Cards()
    reader.feed(markup or "")
    reader.close()
    return [{"title": joined(x["title"]), "url": clean(x["url"]), "summary": joined(x.get("summary", [])), "published_on": joined(x.get("published_on", []))} for x in reader.cards if "url" in x]


CARDS = T.ArrayType(T.StructType([T.StructField(x, TEXT) for x in ("title", "url", "summary", "published_on")]))


@F.pandas_udf(CARDS)
def cards(markup: pd.Series) -> pd.Series:
    return markup.map(read_cards)
