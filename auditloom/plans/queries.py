"""Every operator of the engine as a query over whole tables, and its SQL.

The tables hold no market reports, so most queries first write report text out
of numbers and names, the same in both engines, and then read it back.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import text as t
from ..functions.arrow import ascii_fold, cards
from ..operators import digest, numbering, pages, render, review, rules, state, titles
from ..schema import FINDINGS, REPORT_PAGE, REVIEW_ITEM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return read.select(*columns) if columns else read


def spread(df: DataFrame) -> DataFrame:
    """Dealt by the values of its rows over tasks of bounded size, however many splits and row groups a table comes in. Dealing by values sorts nothing."""
    return df.repartition(numbering.tasks(df), *df.columns)


def text(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def cat(*parts) -> F.Column:
    """Strings as they are, columns as text, joined."""
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def report_rows(df: DataFrame, **columns) -> DataFrame:
    """Rows of REPORT_PAGE with the given columns; the others are empty."""
    filled = {f.name: columns.get(f.name, F.lit("") if f.dataType.simpleString() == "string" else F.array()).cast(f.dataType) for f in REPORT_PAGE.fields}
    return df.select(*(filled[f.name].alias(f.name) for f in REPORT_PAGE.fields))


# --- rules on pages made of order lines

def market_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order line: amounts, growth and years out of its numbers."""
    lines = spread(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey")
    unit = F.element_at(F.array(F.lit("thousand"), F.lit("million"), F.lit("billion")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    end_unit = F.when(p % 7 == 0, "million").otherwise(unit)
    meta = cat("Sales are estimated to be valued at USD ", p % 90 + 10, ".", p % 10, " ", unit, " and to reach USD ", p % 90 + 10 + q, ".5 ", end_unit, " by 2036, at a CAGR of ", q % 12, ".", p % 10, "%.")
    return report_rows(
        lines,
        url=cat("r/", F.col("l_orderkey"), "/", F.col("l_linenumber")),
        card_title=cat("Part ", p, " Market"),
        card_summary=cat("From 2026 - ", 2036 + F.when(p % 23 == 0, 1).otherwise(0)),
        page_title=cat("Part ", p, " - ", 2035 + F.when(p % 5 == 0, 0).otherwise(1)),
        h1=cat("Part ", p, " (2026 - ", 2036 - F.when(p % 11 == 0, 1).otherwise(0), ")"),
        meta_description=meta,
    )


MARKET_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey AS p, CAST(l_quantity AS INT) AS q, CASE l_suppkey % 3 WHEN 0 THEN 'thousand' WHEN 1 THEN 'million' ELSE 'billion' END AS unit FROM lineitem),
page AS (SELECT 'r/' || l_orderkey || '/' || l_linenumber AS url, 'Part ' || p || ' Market' AS card_title,
  'From 2026 - ' || (2036 + CASE WHEN p % 23 = 0 THEN 1 ELSE 0 END) AS card_summary,
  'Part ' || p || ' - ' || (2035 + CASE WHEN p % 5 = 0 THEN 0 ELSE 1 END) AS page_title,
  'Part ' || p || ' (2026 - ' || (2036 - CASE WHEN p % 11 = 0 THEN 1 ELSE 0 END) || ')' AS h1,
  'Sales are estimated to be valued at USD ' || (p % 90 + 10) || '.' || (p % 10) || ' ' || unit || ' and to reach USD ' || (p % 90 + 10 + q) || '.5 ' || CASE WHEN p % 7 = 0 THEN 'million' ELSE unit END || ' by 2036, at a CAGR of ' || (q % 12) || '.' || (p % 10) || '%.' AS meta
  FROM l),
years AS (SELECT *, TRY_CAST(regexp_extract(page_title, '-\\s*(20\\d\\d)\\s*$', 1) AS INT) AS y_title, TRY_CAST(regexp_extract(h1, '(20\\d\\d)\\s*-\\s*(20\\d\\d)', 1) AS INT) AS y0,
  TRY_CAST(regexp_extract(h1, '(20\\d\\d)\\s*-\\s*(20\\d\\d)', 2) AS INT) AS y1, TRY_CAST(regexp_extract(meta, '(?i)\\bby\\s+(20\\d\\d)\\b', 1) AS INT) AS y_meta,
  TRY_CAST(regexp_extract(card_summary, '(20\\d\\d)\\s*-\\s*(20\\d\\d)', 2) AS INT) AS y_card FROM page),
amounts AS (SELECT *, TRY_CAST(regexp_extract(lower(meta), 'valued at\\s+usd\\s+([0-9.]+)\\s+(billion|million|thousand)', 1) AS DOUBLE) * CASE regexp_extract(lower(meta), 'valued at\\s+usd\\s+([0-9.]+)\\s+(billion|million|thousand)', 2) WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 ELSE 1e9 END AS a,
  TRY_CAST(regexp_extract(lower(meta), 'reach\\s+usd\\s+([0-9.]+)\\s+(billion|million|thousand)\\s+by', 1) AS DOUBLE) * CASE regexp_extract(lower(meta), 'reach\\s+usd\\s+([0-9.]+)\\s+(billion|million|thousand)\\s+by', 2) WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 ELSE 1e9 END AS b,
  TRY_CAST(regexp_extract(lower(meta), 'cagr of\\s+([0-9.]+)%', 1) AS DOUBLE) AS stated FROM years),
math AS (SELECT *, (power(b / a, 1.0 / greatest(y1 - y0, 1)) - 1) * 100 AS implied FROM amounts)
"""


@query(MARKET_SQL + "SELECT url, round(implied, 6) AS implied, stated, greatest(y1 - y0, 1) AS periods, abs(implied - stated) > 1.0 AND stated <> 0 AS flagged FROM math")
def q01_market_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, years and growth read from text, and whether they contradict the stated growth."""
    df = rules.with_market_math(market_pages(spark, sf_dir))
    return df.select("url", F.round("implied", 6).alias("implied"), "stated", "periods", rules.growth_contradicted().alias("flagged"))


@query(
    MARKET_SQL
    + """SELECT url, y_title, y1 AS y_h1, y_meta, y_card, len(list_distinct([y_title, y1, y_meta, y_card])) > 1 AS disagree,
  CASE WHEN len(list_distinct([y_title, y1, y_meta, y_card])) > 1 THEN concat_ws(' | ', 'page_title: ' || page_title, 'h1_end: ' || h1, 'meta_description: ' || meta, 'card_summary_end: ' || card_summary) ELSE '' END AS evidence FROM years"""
)
def q02_forecast_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End years from four places, and the finding's evidence where they differ."""
    df = market_pages(spark, sf_dir).select("url", rules.forecast_years().alias("years"))
    df = df.withColumn("found", rules.disagreeing_years(F.col("years")))
    found = F.col("found")
    year = lambda k: F.get("years", F.lit(k))["year"]
    evidence = F.when(F.size(found) > 0, F.array_join(F.get(found, F.lit(0))["evidence"], " | ")).otherwise("")
    return df.select("url", year(0).alias("y_title"), year(1).alias("y_h1"), year(2).alias("y_meta"), year(3).alias("y_card"), (F.size(found) > 0).alias("disagree"), evidence.alias("evidence"))


# --- titles

STOP_SQL = "'" + "','".join(t.STOP_TOKENS) + "'"


def normal_sql(value: str) -> str:
    return f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({value}), '\\([^)]*\\)', ' ', 'g'), '\\b20\\d\\d\\s*-\\s*20\\d\\d\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ({STOP_SQL})), ' ')"


def singular_sql(value: str) -> str:
    token = "CASE WHEN length(x) <= 3 THEN x WHEN length(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN length(x) > 4 AND regexp_matches(x, '(sses|shes|ches|xes|zes|oes)$') THEN x[:-3] WHEN x LIKE '%s' AND NOT regexp_matches(x, '(ss|us|is)$') THEN x[:-2] ELSE x END"
    return f"array_to_string(list_transform(string_split({value}, ' '), lambda x: {token}), ' ')"


FOLD_SQL = "regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')"


@query(
    f"""WITH titles AS (SELECT 'p' || p_partkey AS id, 'Global ' || p_name || ' Market (2026 - 2036) ' || p_brand AS title FROM part
  UNION ALL SELECT 'd' || doc_id, string_split(text, chr(10))[1] FROM documents)
SELECT id, {normal_sql(FOLD_SQL.format("title"))} AS normalized FROM titles"""
)
def q03_title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of parts and first lines of documents, folded to ASCII, without stop tokens and years."""
    parts = table(spark, sf_dir, "part").select(cat("p", F.col("p_partkey")).alias("id"), cat("Global ", F.col("p_name"), " Market (2026 - 2036) ", F.col("p_brand")).alias("title"))
    docs = table(spark, sf_dir, "documents").select(cat("d", F.col("doc_id")).alias("id"), F.split("text", "\n")[0].alias("title"))
    return parts.union(docs).select("id", t.normalized_title(F.col("title"), ascii_fold).alias("normalized"))


PLURALS = ["ies", "sses", "shes", "ches", "xes", "zes", "oes", "ss", "us", "is", "s"]


@query(f"""WITH w AS (SELECT p_partkey, lower(p_name) || {" || ".join(f"' ' || string_split(lower(p_name), ' ')[1] || '{x}'" for x in PLURALS)} AS title FROM part) SELECT p_partkey, title, {singular_sql("title")} AS singular FROM w""")
def q04_singularize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and their first word with every ending, made singular."""
    word = F.split(F.lower("p_name"), " ")[0]
    title = F.concat_ws(" ", F.lower("p_name"), *(F.concat(word, F.lit(x)) for x in PLURALS))
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", title.alias("title")).select("p_partkey", "title", t.singular_title(F.col("title")).alias("singular"))


def part_index(spark: SparkSession, sf_dir: str, name) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part", "p_partkey", "p_name")).select(cat("https://x.example/", F.col("p_partkey")).alias("url"), name.alias("title"), F.col("p_partkey").alias("pos"))
    return titles.with_title_keys(parts, F.col("title"), fold=False)


@query(
    """WITH i AS (SELECT p_partkey AS pos, p_name AS title FROM part), two AS (SELECT title, min(pos) AS first FROM i GROUP BY title),
second AS (SELECT i.title, min(pos) AS second FROM i JOIN two USING (title) WHERE pos > first GROUP BY i.title)
SELECT i.pos, CASE WHEN i.pos = first THEN second ELSE first END AS other FROM i JOIN two USING (title) LEFT JOIN second USING (title)"""
)
def q05_dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every part the first other part of the same title."""
    index = part_index(spark, sf_dir, F.col("p_name"))
    found = titles.duplicates(index, index, dealt_over=numbering.tasks(table(spark, sf_dir, "part")))
    return found.select("pos", F.when(F.col("match.kind") == "exact", F.regexp_extract("match.url", "([0-9]+)$", 1).cast("bigint")).alias("other"))


@query(
    f"""WITH i AS (SELECT p_partkey AS pos, lower(p_name) || ' part' || (p_partkey // 3) || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS title FROM part),
n AS (SELECT pos, {normal_sql("title")} AS normal FROM i), s AS (SELECT pos, normal, {singular_sql("normal")} AS singular FROM n)
SELECT a.pos, CASE WHEN count(b.pos) FILTER (b.normal = a.normal) > 0 THEN 'exact' WHEN count(b.pos) > 0 THEN 'plural' END AS kind,
  CASE WHEN count(b.pos) FILTER (b.normal = a.normal) > 0 THEN min(b.pos) FILTER (b.normal = a.normal) ELSE max(b.pos) END AS other
FROM s a LEFT JOIN s b ON a.singular = b.singular AND a.pos <> b.pos GROUP BY a.pos"""
)
def q06_dup_plural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first other part of the same title, or the last one that differs in a plural."""
    name = cat(F.lower("p_name"), " part", F.floor(F.col("p_partkey") / 3), F.when(F.col("p_partkey") % 2 == 0, "s").otherwise(""))
    index = part_index(spark, sf_dir, name)
    found = titles.duplicates(index, index, dealt_over=numbering.tasks(table(spark, sf_dir, "part")))
    return found.select("pos", F.col("match.kind").alias("kind"), F.regexp_extract("match.url", "([0-9]+)$", 1).cast("bigint").alias("other"))


# --- pages

SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def plain_sql(value: str) -> str:
    out = f"regexp_replace({value}, '<[^>]*>', ' ', 'g')"
    for reference, character in pages.REFERENCES.items():
        out = f"replace({out}, '{reference.replace(chr(39), chr(39) * 2)}', '{character.replace(chr(39), chr(39) * 2)}')"
    return SQUEEZE.format(out)


def inner_sql(name: str) -> str:
    return plain_sql(f"regexp_extract(html, '(?is)<{name}(?:\\s[^>]*)?>(.*?)</{name}\\s*>', 1)")


@query(f"SELECT page_id, {inner_sql('title')} AS page_title, {inner_sql('h1')} AS h1, {inner_sql('h2')} AS lead_summary, '' AS meta_description FROM pages")
def q07_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, first headings and description of every page, by patterns."""
    fields = pages.native_fields(F.col("html"))[:4]
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", *fields)


@query(
    """WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 50) AS long FROM documents)
SELECT doc_id, array_to_string(list_filter(long, lambda x: contains(lower(x), 'the') OR contains(lower(x), 'que'))[1:8], chr(10)) AS first_eight, len(list_filter(long, lambda x: contains(lower(x), 'ing')))::INT AS n_other FROM p"""
)
def q08_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long paragraphs of documents that hold one of some words, the first eight of them."""
    long = pages.long_paragraphs(F.split("text", "\n"))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", long.alias("long"))
    kept = pages.paragraphs_with(F.col("long"), ["the", "que"], pages.SUMMARIES)
    return docs.select("doc_id", F.array_join(kept, "\n").alias("first_eight"), F.size(F.filter("long", lambda x: F.contains(F.lower(x), F.lit("ing")))).alias("n_other"))


PATH_SQL = "rtrim(regexp_extract({}, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/')"


@query(f"SELECT page_id, {SQUEEZE.format('replace(string_split(' + PATH_SQL.format('url') + ', chr(47))[-1], chr(45), chr(32))')} AS slug, {SQUEEZE.format('replace(string_split(' + PATH_SQL.format('link') + ', chr(47))[-1], chr(45), chr(32))')} AS made FROM (SELECT *, 'https://x.example/r/page-no-' || page_id || '-market/?a=1' AS link FROM pages)")
def q09_slug_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title in a url's last part."""
    made = cat("https://x.example/r/page-no-", F.col("page_id"), "-market/?a=1")
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", t.slug_title(F.col("url")).alias("slug"), t.slug_title(made).alias("made"))


# --- polls of a feed made of events


def event_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return events.select(F.col("event_type").alias("title"), cat("u/", F.col("user_id")).alias("url"), F.lit("").alias("summary"), F.lit("").alias("published_on"), F.col("event_id").alias("pos"))


def customers_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey").filter("c_custkey % 3 <> 0").select(cat("u/", F.col("c_custkey")).alias("url"))


FEED_SQL = "WITH c AS (SELECT event_type AS title, 'u/' || user_id AS url, event_id AS pos FROM events), f AS (SELECT title, url, pos FROM c QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1), seen AS (SELECT 'u/' || c_custkey AS url FROM customer WHERE c_custkey % 3 <> 0) "


@query(FEED_SQL + "SELECT title, url, pos FROM f")
def q10_first_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each url the first card of the feed."""
    return state.feed_cards(event_cards(spark, sf_dir)).select("title", "url", "pos")


@query(FEED_SQL + "SELECT title, url, pos FROM f WHERE url NOT IN (SELECT url FROM seen) ORDER BY pos LIMIT 25")
def q11_unseen_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 cards, in feed order, whose url was not seen."""
    return state.admitted(event_cards(spark, sf_dir), customers_seen(spark, sf_dir), True).select("title", "url", "pos")


@query("WITH s AS (SELECT 'e/' || event_id AS url FROM events UNION SELECT c_name FROM customer) SELECT url FROM s ORDER BY url DESC LIMIT 5000")
def q12_seen_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a seen set: the 5000 greatest urls."""
    seen = table(spark, sf_dir, "events", "event_id").select(cat("e/", F.col("event_id")).alias("url")).union(table(spark, sf_dir, "customer").select(F.col("c_name").alias("url")))
    return state.evicted(seen)


@query(
    FEED_SQL
    + """SELECT 'bootstrap' AS how, 0::BIGINT AS admitted, (SELECT count(*) FROM (SELECT url FROM seen UNION SELECT url FROM f)) AS remembered
UNION ALL SELECT 'initial', least(25, (SELECT count(*) FROM f)), (SELECT count(*) FROM (SELECT url FROM seen UNION SELECT url FROM (SELECT url FROM f ORDER BY pos LIMIT 25)))
UNION ALL SELECT 'later', least(25, (SELECT count(*) FROM f WHERE url NOT IN (SELECT url FROM seen))), (SELECT count(*) FROM seen) + least(25, (SELECT count(*) FROM f WHERE url NOT IN (SELECT url FROM seen)))
UNION ALL SELECT 'forced', 1, (SELECT count(*) FROM seen)"""
)
def q13_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards admitted and urls remembered by the four ways to poll."""
    cards, seen, parts = event_cards(spark, sf_dir), customers_seen(spark, sf_dir), []
    ways = {"bootstrap": (False, state.Poll()), "initial": (False, state.Poll(audit_initial=True)), "later": (True, state.Poll()), "forced": (True, state.Poll(force_url="u/x"))}
    for how, (known, poll) in ways.items():
        chosen = state.admitted(cards, seen, known, poll)
        kept = state.remembered(cards, chosen, seen, known, poll)
        parts.append(chosen.agg(F.count("*").alias("admitted")).join(kept.agg(F.count("*").alias("remembered"))).select(F.lit(how).alias("how"), "admitted", "remembered"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


# --- reviews made of labels and documents

REVIEW_CASES = [
    ("numeric_inconsistency", "Numbers", "The market size is given twice", "Fix it", "Please fix"),
    ("unit_scale_error", "Unit", "A million should be a billion", "Fix it", "Please fix"),
    ("unit_scale_error", "Unit", "Nothing of the kind", "Fix it", "Please fix"),
    ("company_name_error", "Name", "The wrong company is in this segment", "Fix it", "Please fix"),
    ("company_development_error", "News", "An acquisition that never was", "Fix it", "Please fix"),
    ("numeric_inconsistency", "Typo", "A typo in the CAGR", "Fix it", "Please fix"),
    ("numeric_inconsistency", "Parts", "The segmentation is inconsistent", "Fix it", "Please fix"),
    ("duplicate_title", "Title", "Multiple numbers", "Fix it", "Please fix"),
    (" Numeric_Inconsistency ", "Numbers", "Conflicting values", "Fix it", " "),
    (" Numeric_Inconsistency ", "Numbers", "Conflicting values", "Fix it", "Please fix"),
]


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review findings: one of ten cases for each document, sure to a degree that depends on its length."""
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars", "source")
    names = ["category", "title", "explanation", "uploader_summary", "correction_instruction"]
    cases = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, case, strict=True))) for case in REVIEW_CASES))
    case = F.get(cases, (F.col("doc_id") % 10).cast("int"))
    item = F.struct(*(case[n].alias(n) for n in names), ((F.col("n_chars") % 101) / 100).alias("confidence"), F.array(*(cat(F.col("source"), str(k)) for k in range(4))).alias("evidence"))
    return docs.select("doc_id", item.cast(REVIEW_ITEM).alias("item"), (F.col("n_chars") % 13 != 0).alias("should_alert"))


def any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


CASES_SQL = ", ".join(f"({k}, " + ", ".join(f"'{v}'" for v in case) + ")" for k, case in enumerate(REVIEW_CASES))
GATE_SQL = f"""WITH k(n, category, title, explanation, summary, instruction) AS (VALUES {CASES_SQL}),
i AS (SELECT doc_id, k.*, (n_chars % 101) / 100.0::DOUBLE AS confidence, n_chars % 13 <> 0 AS should_alert, source FROM documents JOIN k ON doc_id % 10 = n),
x AS (SELECT *, lower(trim(category)) AS c, lower(concat_ws(' ', category, title, explanation, summary, instruction)) AS text FROM i),
g AS (SELECT *, should_alert AND confidence >= 0.90::DOUBLE AND trim(summary) <> '' AND trim(instruction) <> '' AND NOT {any_sql("text", review.MINOR_WORDS)}
  AND NOT ({any_sql("text", review.SEGMENT_WORDS)} AND c NOT IN ('company_name_error', 'company_development_error'))
  AND ({" OR ".join(f"(c = '{c}' AND {any_sql('text', w)})" for c, w in review.CATEGORY_WORDS.items())}) AS kept FROM x)
"""


@query(GATE_SQL + "SELECT doc_id, category, confidence, kept FROM g")
def q14_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reviewer's finding passes: alert, sureness, category, words."""
    items = review_items(spark, sf_dir)
    one = F.struct(F.col("should_alert").alias("should_alert"), F.array("item").alias("findings"))
    return items.select("doc_id", F.col("item.category").alias("category"), F.col("item.confidence").alias("confidence"), (F.size(review.accepted(one)) > 0).alias("kept"))


@query(
    GATE_SQL
    + """, r AS (SELECT doc_id, 'numeric_inconsistency' AS category, 'Numbers' AS title, 'rule' AS source, 0 AS at FROM documents WHERE doc_id % 4 = 0),
n AS (SELECT b.doc_id, category, title, 'openai' AS source, k AS at FROM (SELECT doc_id, category, title, kept, unnest([1, 2]) AS k FROM g) b WHERE kept AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = b.doc_id AND r.category = b.category AND r.title = b.title)
  QUALIFY row_number() OVER (PARTITION BY b.doc_id, category, title ORDER BY k) = 1)
SELECT d.doc_id, count(m.title)::INT AS n_findings, coalesce(string_agg(m.source || ':' || m.title, ',' ORDER BY m.at), '') AS findings,
  coalesce(string_agg(CASE m.source WHEN 'openai' THEN d.source || '0,' || d.source || '1,' || d.source || '2' END, ',' ORDER BY m.at), '') AS evidence FROM documents d LEFT JOIN (SELECT * FROM r UNION ALL SELECT * FROM n) m USING (doc_id) GROUP BY d.doc_id"""
)
def q15_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule findings with the reviewer's new ones behind them; what repeats a category and title goes."""
    items = review_items(spark, sf_dir)
    own = F.when(F.col("doc_id") % 4 == 0, F.array(rules.finding("numeric_inconsistency", "Numbers", "", "", "", 0.98, F.array().cast("array<string>")))).otherwise(F.array()).cast(FINDINGS)
    reviewed = review.accepted(F.struct(F.col("should_alert").alias("should_alert"), F.array("item", "item").alias("findings")))
    found = items.select("doc_id", own.alias("own"), reviewed.alias("reviewed")).select("doc_id", review.merged(F.col("own"), F.col("reviewed")).alias("f"))
    return found.select("doc_id", F.size("f").alias("n_findings"), F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["source"], x["title"])), ",").alias("findings"), F.array_join(F.flatten(F.transform("f", lambda x: x["evidence"])), ",").alias("evidence"))


# --- days


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-09 18:30:00' AND ts < TIMESTAMP '2024-01-10 18:30:00'")
def q16_day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of one calendar day of a time zone."""
    events = table(spark, sf_dir, "events", "event_id", "ts").withColumn("at", F.col("ts").cast("timestamp"))
    return digest.of_day(events, F.lit(dt.date(2024, 1, 10)), "Asia/Calcutta", "at").select("event_id", "ts")


@query(
    """WITH h AS (SELECT event_id, TIMESTAMP '2024-03-09 12:00:00' + to_hours(CAST(event_id % 60 AS INT)) AS spring, TIMESTAMP '2024-11-02 12:00:00' + to_hours(CAST(event_id % 60 AS INT)) AS autumn FROM events)
SELECT event_id, 'spring' AS day, spring AS at FROM h WHERE spring >= TIMESTAMP '2024-03-10 05:00:00' AND spring < TIMESTAMP '2024-03-11 04:00:00'
UNION ALL SELECT event_id, 'autumn', autumn FROM h WHERE autumn >= TIMESTAMP '2024-11-03 04:00:00' AND autumn < TIMESTAMP '2024-11-04 05:00:00'"""
)
def q16b_odd_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a day of 23 hours and of one of 25, an hour apart for each event."""
    events = table(spark, sf_dir, "events", "event_id")

    def of(name: str, start: dt.datetime, day: dt.date) -> DataFrame:
        at = F.timestamp_add("HOUR", (F.col("event_id") % 60).cast("int"), F.lit(start))
        return digest.of_day(events.select("event_id", F.lit(name).alias("day"), at.alias("at")), F.lit(day), "America/New_York", "at")

    spring = of("spring", dt.datetime(2024, 3, 9, 12, tzinfo=dt.UTC), dt.date(2024, 3, 10))
    found = spring.union(of("autumn", dt.datetime(2024, 11, 2, 12, tzinfo=dt.UTC), dt.date(2024, 11, 3)))
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


# --- issues made of orders


def order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed issues: one for each order, with two findings whose instruction many orders share."""
    orders = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def one(title, instruction, evidence):
        return F.struct(F.lit("numeric_inconsistency").alias("category"), title.alias("title"), F.lit("why").alias("explanation"), F.lit("").alias("uploader_summary"), instruction.alias("correction_instruction"), F.lit(0.95).alias("confidence"), F.lit("rule").alias("source"), F.array(evidence).alias("evidence"))

    first = one(cat("Finding ", cust % 7), F.when(cust % 5 == 0, F.lit(" ")).otherwise(cat(" Please fix group ", cust % 40, " ")), cat("e", cust % 3))
    second = one(cat("Finding ", cust % 7), cat("Please check ", F.col("o_orderpriority")), cat("s", F.col("o_orderstatus")))
    return orders.select(
        key.alias("number"),
        cat(digest.ISSUE_PREFIX, " order ", key).alias("title"),
        cat("https://t.example/", key).alias("html_url"),
        cat("Report ", cust % 100).alias("report_title"),
        cat("https://x.example/", cust).alias("report_url"),
        F.lit("unknown").alias("listed_date"),
        F.lit("unknown").alias("page_publish_date"),
        F.array(first, second).cast(FINDINGS).alias("findings"),
    )


ISSUES_SQL = """WITH o AS (SELECT *, 'Report ' || (o_custkey % 100) AS report_title, 'https://x.example/' || o_custkey AS report_url, 'https://t.example/' || o_orderkey AS html_url, 'Finding ' || (o_custkey % 7) AS title FROM orders),
f AS (SELECT report_title, report_url, html_url, 0 AS nth, title, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'Please fix group ' || (o_custkey % 40) END AS instruction, 'e' || (o_custkey % 3) AS evidence FROM o
  UNION ALL SELECT report_title, report_url, html_url, 1, title, 'Please check ' || o_orderpriority, 's' || o_orderstatus FROM o),
m AS (SELECT *, CASE WHEN instruction = '' THEN title ELSE instruction END AS key FROM f QUALIFY row_number() OVER (PARTITION BY report_url, title, instruction, evidence ORDER BY lower(report_title), report_url, html_url, nth) = 1),
g AS (SELECT key, count(*) AS size, row_number() OVER (ORDER BY key) AS number FROM m GROUP BY key)
"""


@query(ISSUES_SQL + "SELECT key, number::INT AS number, size, (SELECT count(*) FROM o) AS issues, (SELECT count(*) FROM g) AS groups, (SELECT sum(size)::BIGINT FROM g) AS findings FROM g")
def q17_digest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of corrections in key order, their sizes, and the counts of the whole digest."""
    issues = order_issues(spark, sf_dir)
    # One row, whatever the number of issues.
    return digest.digest_groups(issues).join(F.broadcast(issues.agg(F.count("*").alias("issues")))).select("key", "number", "size", "issues", "groups", "findings")


@query(ISSUES_SQL + "SELECT m.key, number::INT AS number, html_url, nth, row_number() OVER (PARTITION BY m.key ORDER BY lower(report_title), report_url, html_url, nth)::INT AS place FROM m JOIN g USING (key)")
def q17b_digest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of each group and their order in it."""
    # Two findings an issue.
    dealt_over = 2 * numbering.tasks(table(spark, sf_dir, "orders"))
    return digest.digest_members(order_issues(spark, sf_dir), dealt_over).select("key", "number", "html_url", F.col("at").alias("nth"), "place")


def issue_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue bodies as people may leave them: marks of old and new, lines out of place, bullets that overwrite."""
    orders = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    body = F.concat_ws(
        "\n",
        F.lit("# Alert\n\nlost line"),
        cat("- Report: Report ", cust),
        cat("- URL: https://x.example/", cust),
        F.when(cust % 3 == 0, cat("- Listed date: day ", cust % 28)),
        cat("\n## Findings\n\n### First (unit) ", cust % 9, " (unit_scale_error, rule, confidence 0.9", cust % 10, ")"),
        cat("Because of ", F.col("o_orderpriority")),
        F.when(cust % 2 == 0, cat("\nDumbed-down version for upload team:\n- old summary\n- summary ", key)).otherwise(cat("\nUploader summary:\nno bullet\n- summary ", key)),
        cat("\n- stray bullet\nEvidence:\n- one ", key, "\n- Page publish date: p", cust % 5, "\n- two\n\n- lost"),
        cat("### Second ", key),
        cat("Correction instruction:\n- Please fix ", cust),
    )
    return orders.select(cat("https://t.example/", key).alias("html_url"), body.alias("body"))


@query(
    """SELECT 'https://t.example/' || o_orderkey AS html_url, 'Report ' || o_custkey AS report_title, 'https://x.example/' || o_custkey AS report_url, CASE WHEN o_custkey % 3 = 0 THEN 'day ' || (o_custkey % 28) ELSE 'unknown' END AS listed_date, 'p' || (o_custkey % 5) AS page_publish_date,
  concat_ws('|', 'First', 'unit) ' || (o_custkey % 9) || ' (unit_scale_error', 'rule', '0.9' || CASE WHEN o_custkey % 10 = 0 THEN '' ELSE (o_custkey % 10)::VARCHAR END, 'Because of ' || o_orderpriority, 'summary ' || o_orderkey, '', 'one ' || o_orderkey || '/two') AS first,
  concat_ws('|', 'Second ' || o_orderkey, 'unknown', 'unknown', '0.0', '', '', 'Please fix ' || o_custkey, '') AS second FROM orders"""
)
def q18_issue_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and findings read back out of issue bodies."""
    parsed = digest.parse_bodies(issue_bodies(spark, sf_dir))

    def told(k):
        x = F.get("findings", F.lit(k))
        return F.concat_ws("|", x["title"], x["category"], x["source"], x["confidence"].cast("string"), x["explanation"], x["uploader_summary"], x["correction_instruction"], F.array_join(x["evidence"], "/"))

    return parsed.select("html_url", "report_title", "report_url", "listed_date", "page_publish_date", told(0).alias("first"), told(1).alias("second"))


OLD_WORDS = ["CAGR", "brand", "launch", "application", "Segment", "nothing", "merger"]


def old_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without a summary, and with instructions of which few say please."""
    events = table(spark, sf_dir, "events", "event_id", "user_id")
    word = F.get(F.array(*map(F.lit, OLD_WORDS)), (F.col("event_id") % len(OLD_WORDS)).cast("int"))
    instruction = F.when(F.col("user_id") % 3 == 0, "PLEASE do").when(F.col("user_id") % 3 == 1, "").otherwise("Do it")
    summary = F.when(F.col("user_id") % 5 == 0, " kept ").otherwise(" ")
    parts = {"category": F.lit("other"), "title": cat("About ", word), "explanation": F.lit(""), "uploader_summary": summary, "correction_instruction": instruction, "confidence": F.lit(0.9), "source": F.lit("rule"), "evidence": F.array().cast("array<string>")}
    return events.select("event_id", F.array(F.struct(*(v.alias(k) for k, v in parts.items()))).cast(FINDINGS).alias("findings"))


def cases_sql(cases: list[tuple[list[str], str]]) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql('text', words)} THEN '{value}'" if words else f"ELSE '{value}'" for words, value in cases) + " END"


@query(
    f"""WITH w AS (SELECT event_id, user_id, lower('About ' || [{", ".join(f"'{x}'" for x in OLD_WORDS)}][event_id % {len(OLD_WORDS)} + 1] || ' other ') AS text FROM events)
SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'kept' ELSE {cases_sql(digest.SUMMARIES)} END AS summary, CASE WHEN user_id % 3 = 0 THEN 'PLEASE do' ELSE {cases_sql(digest.INSTRUCTIONS)} END AS instruction FROM w"""
)
def q19_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old findings with the summaries and instructions that they lack."""
    x = F.get("findings", F.lit(0))
    return digest.upgrade(old_findings(spark, sf_dir)).select("event_id", x["uploader_summary"].alias("summary"), x["correction_instruction"].alias("instruction"))


@query(
    ISSUES_SQL
    + """SELECT html_url, '# Report audit alert' || chr(10) || chr(10) || '- Report: ' || report_title || chr(10) || '- URL: ' || report_url || chr(10) || '- Listed date: unknown' || chr(10) || '- Page publish date: unknown' || chr(10) || chr(10) || '## Findings' || chr(10) || chr(10)
  || '### ' || title || ' (numeric_inconsistency, rule, confidence 0.95)' || chr(10) || 'why' || chr(10) || chr(10) || 'Copy-paste fix for upload team:' || chr(10) || '- ' || CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE ' Please fix group ' || (o_custkey % 40) || ' ' END || chr(10) || chr(10) || 'Evidence:' || chr(10) || '- e' || (o_custkey % 3) || chr(10) || chr(10)
  || '### ' || title || ' (numeric_inconsistency, rule, confidence 0.95)' || chr(10) || 'why' || chr(10) || chr(10) || 'Copy-paste fix for upload team:' || chr(10) || '- Please check ' || o_orderpriority || chr(10) || chr(10) || 'Evidence:' || chr(10) || '- s' || o_orderstatus || chr(10) AS body FROM o"""
)
def q20_issue_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue bodies written from findings."""
    return render.rewritten(order_issues(spark, sf_dir)).select("html_url", F.col("rendered").alias("body"))


@query(
    """WITH held AS (SELECT 'title ' || (o_orderkey // 2) AS title, min_by(o_orderpriority, o_orderkey) AS body FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 5 <> 0 GROUP BY 1)
SELECT w.title, CASE WHEN held.title IS NULL THEN 'create' WHEN held.body <> w.body THEN 'update' ELSE 'noop' END AS action FROM (SELECT 'title ' || o_orderkey AS title, '1-URGENT' AS body FROM orders) w LEFT JOIN held USING (title)"""
)
def q21_upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an issue is to be created, updated or left alone."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    held = orders.select(key.alias("number"), cat("title ", F.floor(key / 2)).alias("title"), F.col("o_orderpriority").alias("body"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), F.when(key % 5 == 0, "{}").alias("pull_request"))
    wanted = orders.select(cat("title ", key).alias("title"), F.lit("1-URGENT").alias("body"))
    return digest.upsert_actions(wanted, held).select("title", "action")


@query(
    """WITH held AS (SELECT DISTINCT 'title ' || (o_orderkey // 2) AS title FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 5 <> 0)
SELECT 'title ' || o_orderkey AS title FROM orders WHERE 'title ' || o_orderkey NOT IN (SELECT title FROM held)"""
)
def q21b_missing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues to create: those whose title no open issue has."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    key = F.col("o_orderkey")
    held = orders.select(cat("title ", F.floor(key / 2)).alias("title"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), F.when(key % 5 == 0, "{}").alias("pull_request"))
    return digest.missing_issues(orders.select(cat("title ", key).alias("title")), held)


# --- JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.none') IS NULL AS without FROM events")
def q22_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member of JSON kept as a variant."""
    events = table(spark, sf_dir, "events", "event_id", "props").withColumn("v", F.try_parse_json("props"))
    return events.select("event_id", F.try_variant_get("v", "$.k", "int").alias("k"), F.try_variant_get("v", "$.none", "string").isNull().alias("without"))


@query(
    """SELECT page_id, 'd' || page_id AS publish_date, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Q' || page_id || '=A & B' END AS faq, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS n_faq FROM pages"""
)
def q23_jsonld_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs and the date out of JSON-LD, one script of which is broken, and one has lists within lists."""
    script = lambda *x: cat('<script type="application/ld+json">', *x, "</script>")
    page = F.col("page_id")
    answer = F.when(page % 3 == 0, " ").otherwise("A &amp;\n B")
    html = F.concat(script("{broken"), script('["x", [[{"@graph": [[{"datePublished": "no"}], {"datePublished": "d', page, '"}, 3]}], [[]]], 5]'), script('{"@type": "FAQPage", "datePublished": "later", "mainEntity": [{"name": "Q', page, '", "acceptedAnswer": {"text": "', answer, '"}}, {"name": "no answer"}]}'))
    faq, date = pages.faq_and_date(F.col("html"))
    df = table(spark, sf_dir, "pages", "page_id").select("page_id", html.alias("html")).select("page_id", date.alias("publish_date"), faq.alias("faq"))
    return df.select("page_id", "publish_date", F.array_join(F.transform("faq", lambda x: F.concat_ws("=", x["question"], x["answer"])), "|").alias("faq"), F.size("faq").alias("n_faq"))


# --- whole runs


@query(
    MARKET_SQL
    + """, f AS (SELECT url, card_title, (len(list_distinct([y_title, y1, y_meta, y_card])) > 1)::INT AS by_years, coalesce(abs(implied - stated) > 1.0 AND stated <> 0, false)::INT AS by_growth, CASE WHEN count(*) OVER (PARTITION BY card_title) > 1 THEN 1 ELSE 0 END AS by_title FROM math)
SELECT count(*) AS audited, count(*) FILTER (by_years + by_growth + by_title > 0) AS with_issues, sum(by_years)::BIGINT AS years, sum(by_growth)::BIGINT AS growth, sum(by_title)::BIGINT AS titles FROM f"""
)
def q24_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three rules on every page, the title index being the pages' own titles; counts of a run."""
    made = market_pages(spark, sf_dir)
    index = titles.with_title_keys(made.select("url", F.col("card_title").alias("title"), F.col("url").alias("pos")), F.col("title"), fold=False)
    found = rules.rule_flags(made, index, fold=False, unique_urls=True)
    return found.agg(F.count("*").alias("audited"), F.count_if(F.col("years") | F.col("growth") | F.col("titles")).alias("with_issues"), *(F.count_if(F.col(x)).alias(x) for x in ("years", "growth", "titles")))


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+05:30') WHEN 2 THEN '' ELSE 'no time' END AS raw, ts, event_id % 4 AS k FROM events)
SELECT event_id, raw, coalesce(CASE k WHEN 0 THEN TIMESTAMP '2024-01-15 12:00:00' - date_trunc('second', ts) <= INTERVAL 24 HOUR WHEN 1 THEN TIMESTAMP '2024-01-15 12:00:00' - (date_trunc('second', ts) - INTERVAL 330 MINUTE) <= INTERVAL 24 HOUR END, false) AS fresh FROM t"""
)
def q25_title_index_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an index read at some time is still fresh; what is no time is not."""
    events = table(spark, sf_dir, "events", "event_id", "ts")
    kind = F.col("event_id") % 4
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(kind == 0, cat(at, "Z")).when(kind == 1, cat(at, "+05:30")).when(kind == 2, "").otherwise("no time")
    age = F.lit(dt.datetime(2024, 1, 15, 12, tzinfo=dt.UTC)) - t.iso_timestamp(F.col("raw"))
    return events.select("event_id", raw.alias("raw")).select("event_id", "raw", F.coalesce(age <= F.expr("INTERVAL '24' HOUR"), F.lit(False)).alias("fresh"))


# --- texts for people, and markup, made of suppliers, parts and customers


def supplier_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed issues: one for each supplier, with one finding; suppliers of a nation share its instruction."""
    k = F.col("s_suppkey")
    parts = {"category": F.lit("numeric_inconsistency"), "title": F.lit("Numbers"), "explanation": F.lit("why"), "uploader_summary": F.when(k % 2 == 0, cat("summary ", k)).otherwise(""), "correction_instruction": F.when(k % 7 == 0, "").otherwise(cat("Please fix nation ", F.col("s_nationkey"))), "confidence": F.lit(0.95), "source": F.lit("rule"), "evidence": F.when(k % 3 == 0, F.array(cat("e", k), F.lit("more"))).otherwise(F.array())}
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(
        k.alias("number"),
        cat(digest.ISSUE_PREFIX, " supplier ", k).alias("title"),
        cat("https://t.example/", k).alias("html_url"),
        cat("2024-01-", k % 3 + 10, "T", F.lpad(text(k % 24), 2, "0"), ":15:00Z").alias("created_at"),
        cat("Report ", k % 10).alias("report_title"),
        cat("https://x.example/", k).alias("report_url"),
        F.lit("unknown").alias("listed_date"),
        F.lit("unknown").alias("page_publish_date"),
        F.array(F.struct(*(v.alias(n) for n, v in parts.items()))).cast(FINDINGS).alias("findings"),
    )


SUPPLIERS_SQL = """WITH s AS (SELECT s_suppkey AS k, 'Report ' || (s_suppkey % 10) AS report_title, 'https://x.example/' || s_suppkey AS report_url, 'https://t.example/' || s_suppkey AS html_url,
  TIMESTAMP '2024-01-10 00:15:00' + to_days(CAST(s_suppkey % 3 AS INT)) + to_hours(s_suppkey % 24) AS created_at, CASE WHEN s_suppkey % 2 = 0 THEN 'summary ' || s_suppkey ELSE 'why' END AS plain, CASE WHEN s_suppkey % 7 <> 0 THEN 'Please fix nation ' || s_nationkey END AS instruction FROM supplier),
"""


@query(
    SUPPLIERS_SQL
    + r"""m AS (SELECT *, coalesce(instruction, 'Numbers') AS key, concat_ws(chr(10), '### ' || report_title, '- Report URL: ' || report_url, '- Issue: ' || html_url, '- Finding: Numbers', '- Category: numeric_inconsistency | Source: rule | Confidence: 0.95',
  '- Dumbed-down version: ' || plain, '- Why this is an error: why', CASE WHEN k % 3 = 0 THEN '- Exact sentence(s):' || chr(10) || '  - e' || k || chr(10) || '  - more' ELSE '- Exact sentence(s): not captured' END, '') AS member FROM s),
g AS (SELECT key, count(*) AS size, row_number() OVER (ORDER BY key) AS number, string_agg(member, chr(10) ORDER BY lower(report_title), report_url, html_url) AS members FROM m GROUP BY key),
t AS (SELECT string_agg('## Correction Group ' || number || chr(10) || 'Copy-paste fix for upload team: ' || key || chr(10) || 'Affected findings: ' || size || chr(10) || chr(10) || members, chr(10) ORDER BY number) AS sections, count(*) AS groups, sum(size)::BIGINT AS findings FROM g)
SELECT concat_ws(chr(10), '# Open correction digest', '', 'Rewritten by each run from the report issues that are open at the time.', 'Work through the corrections below; they are gathered by what has to be done.', '', '- Open report issues: ' || (SELECT count(*) FROM s), '- Unique correction groups: ' || groups, '- Unique findings: ' || findings, '', rtrim(sections, chr(10)), '') AS body FROM t"""
)
def q26_digest_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the digest of all open issues."""
    return render.digest_body(supplier_issues(spark, sf_dir))


@query(
    SUPPLIERS_SQL
    + r"""d AS (SELECT *, concat_ws(chr(10), '## ' || report_title, '- Report URL: ' || report_url, '- Issue: ' || html_url, '- Listed date: unknown', '- Page publish date: unknown', '', '### Numbers', 'Category: numeric_inconsistency | Source: rule | Confidence: 0.95',
  'Dumbed-down version: ' || plain, 'Why this is an error: why', 'Copy-paste fix for upload team: ' || coalesce(instruction, 'Please compare this finding with your sources and correct the page accordingly.'),
  'Exact sentence(s):', CASE WHEN k % 3 = 0 THEN '- e' || k || chr(10) || '- more' ELSE '- No evidence snippet was captured in the issue body.' END, '') AS section FROM s WHERE created_at >= TIMESTAMP '2024-01-10 18:30:00' AND created_at < TIMESTAMP '2024-01-11 18:30:00')
SELECT concat_ws(chr(10), '# Report audit daily summary for January 11, 2024', '', '- Time zone: Asia/Calcutta', '- Repository: example/reports', '- Reports with issues: ' || count(*), '- Total findings: ' || count(*), '', CASE WHEN count(*) = 0 THEN 'Nothing was reported on this day.' ELSE rtrim(string_agg(section, chr(10) ORDER BY created_at DESC, html_url DESC), chr(10)) END, '') AS body FROM d"""
)
def q27_daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a day's summary, newest issue first."""
    day, zone = F.lit(dt.date(2024, 1, 11)), "Asia/Calcutta"
    return render.daily_summary(digest.of_day(supplier_issues(spark, sf_dir), day, zone), day, zone, "example/reports")


def audited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited pages: one for each part, three in four with one or two findings, some without a card's title."""
    k, name = F.col("p_partkey"), F.col("p_name")
    one = lambda title, confidence, evidence: rules.finding("numeric_inconsistency", title, "why", "", "Please fix", confidence, evidence)
    first, second = one("Numbers", 0.98, F.array(name)), one("Years", 0.5, F.array().cast("array<string>"))
    found = F.when(k % 4 == 0, F.array().cast(FINDINGS)).when(k % 4 == 1, F.array(first).cast(FINDINGS)).otherwise(F.array(first, second).cast(FINDINGS))
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select(cat("https://x.example/", k).alias("url"), F.when(k % 3 == 0, "").otherwise(name).alias("card_title"), F.col("p_brand").alias("h1"), F.lit("").alias("page_title"), F.lit("").alias("card_published_on"), F.lit("2026-05-01").alias("publish_date"), found.alias("findings"))


PARTS_SQL = "WITH p AS (SELECT p_partkey AS k, p_name, 'https://x.example/' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS title FROM part WHERE p_partkey % 4 <> 0) "


@query(PARTS_SQL + "SELECT url, concat_ws(chr(10), '## ' || title, url, '', '- Numbers [numeric_inconsistency, rule, 0.98]', CASE WHEN k % 4 > 1 THEN '- Years [numeric_inconsistency, rule, 0.50]' END, '') AS section FROM p")
def q28_run_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of a run's markdown for every page with findings."""
    return render.run_sections(audited_parts(spark, sf_dir)).select("url", "section")


@query(
    PARTS_SQL
    + """SELECT url, to_json({'url': url, 'title': title, 'findings': list_filter([{'category': 'numeric_inconsistency', 'title': 'Numbers', 'explanation': 'why', 'uploader_summary': '', 'correction_instruction': 'Please fix', 'confidence': 0.98::DOUBLE, 'source': 'rule', 'evidence': [p_name]},
  {'category': 'numeric_inconsistency', 'title': 'Years', 'explanation': 'why', 'uploader_summary': '', 'correction_instruction': 'Please fix', 'confidence': 0.5::DOUBLE, 'source': 'rule', 'evidence': []}], lambda x: x.title = 'Numbers' OR k % 4 > 1)})::VARCHAR AS entry FROM p"""
)
def q28b_run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of a run's JSON for every page with findings."""
    return render.run_entries(audited_parts(spark, sf_dir)).select("url", F.to_json(F.struct("*")).alias("entry"))


@query(PARTS_SQL + "SELECT '[Report audit] Glaring errors detected: ' || title AS title, 'https://x.example/' || k AS url, concat_ws(chr(10), '# Report audit alert', '', '- Report: ' || title, '- URL: ' || url, '- Listed date: unknown', '- Page publish date: 2026-05-01', '', '## Findings', '', '### Numbers (numeric_inconsistency, rule, confidence 0.98)', 'why', '', 'Copy-paste fix for upload team:', '- Please fix', '', 'Evidence:', '- ' || p_name, CASE WHEN k % 4 > 1 THEN concat_ws(chr(10), '', '### Years (numeric_inconsistency, rule, confidence 0.50)', 'why', '', 'Copy-paste fix for upload team:', '- Please fix') END, '') AS body FROM p")
def q28c_new_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and body of the issue for every page with findings."""
    return render.new_issues(audited_parts(spark, sf_dir))


def customer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as a tracker holds them, one for each customer: half are as they would be written today; some are closed, pull requests or about something else."""
    k = F.col("c_custkey")
    body = F.concat_ws(
        "\n",
        F.lit("# Report audit alert\n"),
        cat("- Report: Report ", k),
        cat("- URL: https://x.example/", k),
        F.lit("- Listed date: unknown\n- Page publish date: unknown\n\n## Findings\n\n### Numbers (numeric_inconsistency, rule, confidence 0.95)\nwhy\n"),
        F.when(k % 7 != 0, cat(F.when(k % 2 == 0, "Dumbed-down version for upload team:").otherwise("Uploader summary:"), "\n- summary ", k, "\n")),
        cat("Copy-paste fix for upload team:\n- Please fix ", k, "\n"),
        cat("Evidence:\n- e", k, "\n"),
    )
    title = cat(F.when(k % 13 == 0, "About").otherwise(digest.ISSUE_PREFIX), " report ", k)
    return spread(table(spark, sf_dir, "customer", "c_custkey")).select(k.alias("number"), title.alias("title"), cat("https://t.example/", k).alias("html_url"), F.lit("").alias("created_at"), body.alias("body"), F.when(k % 5 == 0, "closed").otherwise("open").alias("state"), F.when(k % 11 == 0, "{}").alias("pull_request"))


@query(
    """SELECT c_custkey AS number, 'update' AS action, '[Report audit] Glaring errors detected: report ' || c_custkey AS title, concat_ws(chr(10), '# Report audit alert', '', '- Report: Report ' || c_custkey, '- URL: https://x.example/' || c_custkey, '- Listed date: unknown', '- Page publish date: unknown', '', '## Findings', '', '### Numbers (numeric_inconsistency, rule, confidence 0.95)', 'why', '', 'Dumbed-down version for upload team:',
  '- ' || CASE WHEN c_custkey % 7 = 0 THEN 'The market numbers on this page do not match and need correction before upload.' ELSE 'summary ' || c_custkey END, '', 'Copy-paste fix for upload team:', '- Please fix ' || c_custkey, '', 'Evidence:', '- e' || c_custkey, '') AS body
FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND (c_custkey % 2 <> 0 OR c_custkey % 7 = 0)"""
)
def q29_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of the open report issues whose body would be written otherwise today."""
    return api.backfill_actions(customer_issues(spark, sf_dir))


@query(
    """SELECT 'r/' || p_partkey AS url, p_name || ' & Co' AS page_title, p_name || ' Market' AS h1, 'About ' || p_name || ' <2>' AS lead_summary, 'All "' || p_name || '" & more' AS meta_description, 'd' || p_partkey AS publish_date,
  'The market of ' || p_name || ' is read by many people in all of the regions' AS summary, 'The Key Players of ' || p_brand || ' went on acquiring others in the year' AS competitive, 'Q' || p_partkey || '=A & B' AS faq FROM part"""
)
def q30_exact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of pages read from their trees: headings, description, paragraphs, questions, date."""
    k, name = F.col("p_partkey"), F.col("p_name")
    html = cat(
        "<html><head><title> ", name, " &amp;\n Co </title><meta content='All &quot;", name, "&quot; &amp; more' name=\"description\"></head><body><h1>", name, " <b>Market</b></h1><h1>other</h1><h2>About ", name, " &lt;&#50;&gt;</h2>",
        "<p>The market of <i>", name, "</i> is read by many people\n in all of the regions</p><p>A short market</p><p>The Key Players of ", F.col("p_brand"), " went on acquiring others in the year</p>",
        '<script type="application/ld+json">{"@graph": [{"@type": "FAQPage", "datePublished": "d', k, '", "mainEntity": [{"name": "Q', k, '", "acceptedAnswer": {"text": "A &amp; B"}}]}]}</script></body></html>',
    )
    read = pages.report_pages(spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")).select(cat("r/", k).alias("url"), html.alias("html")))
    return read.select("url", "page_title", "h1", "lead_summary", "meta_description", "publish_date", F.array_join("summary_paragraphs", "|").alias("summary"), F.array_join("competitive_paragraphs", "|").alias("competitive"), F.array_join(F.transform("faq_items", lambda x: F.concat_ws("=", x["question"], x["answer"])), "|").alias("faq"))


@query("SELECT s_suppkey, '/r/' || s_suppkey AS url, s_name || ' & Co' AS title, 'Nation ' || s_nationkey || ' <x>' AS summary, CASE WHEN s_suppkey % 2 = 0 THEN 'May 0' || (s_suppkey % 9 + 1) || ', 2026' ELSE '' END AS published_on FROM supplier")
def q31_feed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards out of feed markup; those without a linked heading are left out."""
    k = F.col("s_suppkey")
    date = F.when(k % 2 == 0, cat('<div class="date_box"> May 0', k % 9 + 1, ",  2026</div>")).otherwise("")
    markup = cat('<div class="x rep_div"><h3><a href="/r/', k, '"> ', F.col("s_name"), ' &amp;\n Co</a></h3><div class="info_content"><p>Nation ', F.col("s_nationkey"), " &lt;x&gt;</p><p>more</p></div>", date, '</div><div class="rep_div"><h3>no link</h3></div>')
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey").select("s_suppkey", F.explode(cards(markup)).alias("card")).select("s_suppkey", "card.url", "card.title", "card.summary", "card.published_on")
