import json
import random

from pyspark.sql import functions as F

from auditloom.functions import text as t
from auditloom.functions.arrow import ascii_fold, clean, normalize, read_cards, read_page
from auditloom.operators.pages import faq_and_date


def values(spark, made, *rows):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string")
    return [r[1] for r in df.select("k", made(F.col("x"))).orderBy("k").collect()]


def test_years(spark):
    assert values(spark, t.trailing_year, "Steam Market - 2035", "Steam – 2036 ", "Steam 2035", "") == [2035, 2036, None, None]
    assert values(spark, t.range_start, "(2026 - 2036)", "2026 to 2036", "2036–2026 and 2040-2041") == [2026, None, 2036]
    assert values(spark, t.range_end, "(2026 - 2036)", "12026-20361") == [2036, 2036]
    assert values(spark, t.year_after_by, "by 2036.", "BY  2036", "baby 2036", "by 20361") == [2036, 2036, None, None]


def test_growth_and_amounts(spark):
    assert values(spark, t.stated_growth, "a CAGR of 10.0%", "cagr of 2.4.%", "cagr of 5 %", "CAGR of 0%") == [10.0, None, None, 0.0]
    start = values(spark, t.start_amount, "valued at USD 1.0 billion", "worth usd 950 million", "in 2026 it is\nusd 2 billion", "in 2026, sales hit usd 2 thousand", "USD 3 billion")
    assert start == [1e9, 9.5e8, None, 2000.0, None]
    # The first pattern wins over an earlier match of the second one.
    assert values(spark, t.start_amount, "in 2036 reach USD 9 billion, valued at USD 1 million") == [1e6]
    assert values(spark, t.end_amount, "to reach USD 2.6 billion by 2036", "reach USD 2.6 billion in 2036") == [2.6e9, None]


def test_implied_growth(spark):
    rows = [(1e9, 2.6e9, 10, 10.0265), (9.5e8, 1.2e9, 10, 2.3637), (1e9, 2.6e6, 10, -44.8561), (1.2e9, 1.6e9, 10, 2.9186), (1.0, 2.0, -4, 100.0)]
    df = spark.createDataFrame(rows, "a double, b double, n int, want double")
    for r in df.select("want", t.implied_growth(F.col("a"), F.col("b"), F.col("n")).alias("got")).collect():
        assert abs(r.want - r.got) < 1e-4
    zero = spark.createDataFrame([(0.0, 1.0, 1)], "a double, b double, n int")
    assert zero.select(t.implied_growth(F.col("a"), F.col("b"), F.col("n"))).first()[0] is None


def test_titles(spark):
    normal = lambda c: t.normalized_title(c, ascii_fold)
    got = values(spark, normal, "Global Steam Trap Market Analysis (2026-2036)", "Café Crème Industry 2026 - 2036", "Steam – 2026–2036", "the market")
    assert got == ["steam trap", "cafe creme", "steam 20262036", ""]
    assert values(spark, t.singular_title, "berries boxes buses glass series sizes shoes gas traps bus") == ["berry box buse glass sery siz sho gas trap bus"]
    assert values(spark, t.slug_title, "https://x.org/reports/steam-trap-market/?a=1#b", "https://x.org", "no url at all") == ["steam trap market", "", "no url at all"]


def test_numbers_are_written_as_python_does(spark):
    rng = random.Random(1)
    xs = [0.125, 0.945, 1.005, 0.94, 2.5, -0.001, 1234567.891] + [round(rng.uniform(-50, 50), rng.choice([1, 2, 3])) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (1, 2):
        assert [r[0] for r in df.select(t.fixed(F.col("x"), d)).collect()] == [f"{x:.{d}f}" for x in xs]


def test_white_space_and_references(spark):
    assert values(spark, normalize, " a&nbsp;&amp;\n b ", None) == ["a & b", ""]
    assert values(spark, t.squeeze, " a \t b ") == ["a b"]
    assert clean("&amp;lt;") == "&lt;"


def test_page_tree():
    page = """<title> A &amp; B </title><meta name="description" content="By 2036"><h1>One</h1><h1>Two</h1><h2></h2><h2>x</h2>
    <p>first <b>bold</b><p>second</p>
    <script type="application/ld+json">{"@graph": [{"datePublished": null}, {"datePublished": "2026-01-02"}, 3]}</script>
    <script type="application/ld+json">broken {</script>
    <script type="application/ld+json">[[{"@type": "FAQPage", "mainEntity": [{"name": "Q", "acceptedAnswer": {"text": "A"}}, {"name": "Q2"}, 7, {"name": "L", "acceptedAnswer": ["x"]}]}]]</script>"""
    got = read_page(page)
    assert (got["page_title"], got["h1"], got["lead_summary"], got["meta_description"]) == ("A & B", "One", "", "By 2036")
    # An unclosed paragraph holds the next one.
    assert got["paragraphs"] == ["first bold second", "second"]
    assert got["publish_date"] == "2026-01-02" and got["faq_items"] == [{"question": "Q", "answer": "A"}]
    assert read_page(None)["h1"] == ""


def test_cards():
    markup = """<div class="rep_div"><h3><a href=" /a ">A &amp; <b>B</b></a></h3><div class="info_content"><p>Sum</p><p>no</p></div><div class="date_box">May</div></div>
    <div class="rep_div"><h3>no link</h3></div><div class="rep_div x"><h3><a href="/c">C</a></h3></div>"""
    assert read_cards(markup) == [{"title": "A & B", "url": "/a", "summary": "Sum", "published_on": "May"}, {"title": "C", "url": "/c", "summary": "", "published_on": ""}]


def test_nested_json_ld_as_the_tree_reader_has_it(spark):
    """Lists within lists, graphs within lists, members of graphs that are none: the native way gives what the exact one gives."""
    rng = random.Random(4)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if depth and kind < 0.65:
            return {"@graph": [value(depth - 1) for _ in range(rng.randrange(3))]}
        if kind < 0.8:
            return rng.choice([1, "x", None, True, {}])
        entities = [{"name": f"q{rng.random()}", "acceptedAnswer": {"text": "a"}}, rng.choice([3, {"name": "no answer"}, []])]
        return rng.choice([{"datePublished": f"d{rng.random()}"}, {"@type": "FAQPage", "mainEntity": entities}, {"@type": "FAQPage", "mainEntity": "none"}])

    pages = ["".join(f'<script type="application/ld+json">{json.dumps(value(6))}</script>' for _ in range(3)) for _ in range(150)]
    pages += ['<script type="application/ld+json">' + "[" * 60 + '{"datePublished": "deep"}' + "]" * 60 + "</script>", ""]
    faq, date = faq_and_date(F.col("html"))
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", faq.alias("faq"), date.alias("date")).collect()
    for r in rows:
        exact = read_page(pages[r["k"]])
        assert ([x.asDict() for x in r["faq"]], r["date"]) == (exact["faq_items"], exact["publish_date"])
    assert sum(bool(r["faq"]) for r in rows) > 10 and sum(bool(r["date"]) for r in rows) > 10
