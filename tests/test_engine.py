import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from auditloom import api
from auditloom.config import Config, poll_arguments, summary_arguments
from auditloom.operators import digest, render, review, rules, state, titles
from auditloom.operators.pages import report_pages
from auditloom.schema import FINDINGS, ISSUE, REPORT_PAGE, SEEN
from auditloom.sources import http, sinks, tables
from auditloom.streaming import poll

BASE = dict(
    url="https://x.example/steam",
    card_title="Steam Trap Market & More",
    card_summary="Sales from 2026 to 2036.",
    card_published_on="May 01, 2026",
    page_title="Steam Trap Market - 2036",
    h1="Steam Trap Market (2026 - 2036)",
    meta_description="It is estimated to be valued at USD 1.2 billion in 2026 and to reach USD 1.6 billion by 2036, at a CAGR of 2.9%.",
    lead_summary="",
    publish_date="2026-05-02T00:00:00+05:30",
    summary_paragraphs=[],
    competitive_paragraphs=[],
    faq_items=[],
)


def page(spark, **other):
    return spark.createDataFrame([tuple((BASE | other)[n] for n in REPORT_PAGE.names)], REPORT_PAGE)


def found(spark, index=None, **other):
    return rules.rule_findings(page(spark, **other), index).first()["findings"]


def meta(start, end, growth):
    return f"It is valued at USD {start} and to reach USD {end} by 2036, at a CAGR of {growth}%."


def test_years(spark):
    assert found(spark) == []
    (one,) = found(spark, page_title="Steam Trap Market - 2035")
    assert one["category"] == "numeric_inconsistency" and one["confidence"] == 0.98
    assert one["evidence"][0] == "page_title: Steam Trap Market - 2035" and len(one["evidence"]) == 3


@pytest.mark.parametrize(
    ("start", "end", "growth", "flagged"),
    [("1.0 billion", "2.6 billion", "10.0", False), ("950 million", "1.2 billion", "2.4", False), ("1.0 billion", "2.6 million", "10.0", True), ("1.0 billion", "2.6 billion", "0", False), ("1.0 billion", "2.6 billion", "8.9", True), ("1.0 billion", "2.6 billion", "9.1", False), ("1.0 billion", "2.6 billion", "2.4.", False), ("0 billion", "2.6 billion", "3", False)],
)
def test_growth(spark, start, end, growth, flagged):
    got = found(spark, meta_description=meta(start, end, growth))
    assert bool(got) == flagged
    if flagged:
        assert got[0]["confidence"] == 0.94 and "over 10 years" in got[0]["explanation"]


def test_growth_reads_questions_and_reversed_years(spark):
    faq = [{"question": "How big?", "answer": "valued at USD 1 million"}]
    got = found(spark, meta_description="reach usd 3 million by 2036", faq_items=faq, summary_paragraphs=["cagr of 3%"], h1="(2036 - 2026)", page_title="x", card_summary="")
    assert [x["title"] for x in got] == ["Forecast years disagree across the same report page", "Published CAGR does not match the exposed market values"]
    assert "200.0% CAGR over 1 years" in got[1]["explanation"]


def index(spark, *rows):
    df = spark.createDataFrame([(u, x, k) for k, (u, x) in enumerate(rows)], "url string, title string, pos long")
    return titles.with_title_keys(df, F.col("title"))


def test_duplicate_titles(spark):
    own, name = BASE["url"], "Steam Trap Market and More"
    kinds = lambda *rows: [(x["confidence"], x["evidence"][2]) for x in found(spark, index(spark, *rows))]
    assert kinds((own, name)) == []
    assert kinds(("a", "Steam Traps More"), ("b", name), ("c", name)) == [(0.99, "existing_url: b")]
    assert kinds(("a", "Steam Traps More"), ("b", "Steam Trap Mores"), (own, name)) == [(0.96, "existing_url: b")]
    assert kinds(("a", "Steam Trap Valves")) == []
    assert kinds(("", name)) == []
    assert found(spark, index(spark, ("a", "the market")), card_title="", h1="", page_title="") == []


def item(**other):
    base = {"category": "company_development_error", "title": "News", "explanation": "An acquisition was invented", "uploader_summary": "s", "correction_instruction": "Please fix", "confidence": 0.9, "evidence": ["1", "2", "3", "4"]}
    return base | other


@pytest.mark.parametrize(
    ("other", "kept"),
    [({}, True), ({"confidence": 0.89}, False), ({"confidence": None}, False), ({"explanation": "An editorial typo in the acquisition"}, False), ({"category": "unit_scale_error", "explanation": "million for billion"}, True), ({"category": "unit_scale_error", "explanation": "million in a segment"}, False), ({"explanation": "merger in a segment"}, True), ({"uploader_summary": " "}, False), ({"correction_instruction": ""}, False), ({"category": "other"}, False), ({"category": "company_name_error", "explanation": "segment mismatch"}, False)],
)
def test_gate(spark, other, kept):
    response = json.dumps({"should_alert": True, "summary": "", "findings": [item(**other)]})
    df = spark.createDataFrame([(response,)], "r string")
    got = df.select(review.accepted(review.parsed(F.col("r"))).alias("f")).first()["f"]
    assert bool(got) == kept and all(len(x["evidence"]) == 3 and x["source"] == "openai" for x in got)


def test_reviews_are_merged(spark):
    audited = rules.rule_findings(page(spark, page_title="x - 2035"))
    twice = item(category="numeric_inconsistency", title="Forecast years disagree across the same report page", explanation="multiple numbers")
    response = json.dumps({"should_alert": True, "summary": "", "findings": [twice, item(), item()]})
    reviews = spark.createDataFrame([(BASE["url"], response)], "url string, response string")
    assert [x["source"] for x in review.with_reviews(audited, reviews).first()["findings"]] == ["rule", "openai"]
    for bad in ("not json", json.dumps({"should_alert": False, "findings": [item()]}), None):
        assert len(review.with_reviews(audited, spark.createDataFrame([(BASE["url"], bad)], "url string, response string")).first()["findings"]) == 1
    prompt = json.loads(review.prompts(audited).first()["prompt"])
    assert prompt["report"]["h1"] == BASE["h1"] and prompt["rule_findings"].startswith("- Forecast years")
    asked = review.ask(review.prompts(audited).withColumnRenamed("url", "key"), lambda: lambda text: {"should_alert": False, "n": len(text)})
    assert json.loads(asked.first()["response"])["n"] > 100


HTML = """<html><head><title>T - 2035</title><meta name="description" content="by 2036"></head><body><h1>H (2026 - 2036)</h1>
<p>This market paragraph is long enough to be kept as one, surely so.</p><p>short market</p><p>The key players of this field are many and they are acquiring others.</p></body></html>"""


@pytest.mark.parametrize("exact", [True, False])
def test_pages(spark, exact):
    row = report_pages(spark.createDataFrame([("u", HTML), ("v", None)], "url string, html string"), exact).orderBy("url").collect()
    assert (row[0].page_title, row[0].h1, row[0].meta_description) == ("T - 2035", "H (2026 - 2036)", "by 2036")
    assert len(row[0].summary_paragraphs) == 1 and len(row[0].competitive_paragraphs) == 1 and row[1].h1 == ""
    assert api.audit(spark.createDataFrame([("u", HTML)], "url string, html string"), exact=exact).first()["findings"][0]["confidence"] == 0.98


BODY = """# Alert

- Report: Steam (big) market
- URL: https://x.example/steam
- Listed date: May 1

## Findings

### Years differ (numeric_inconsistency, rule, confidence 0.98)
They differ.

Dumbed-down version for upload team:
- Numbers are off.

Copy-paste fix for upload team:
- Please align.

Evidence:
- one
- two

### Old one
Wrong company here
"""


def issues(spark, *rows):
    full = [(k, *x, "open", None) if len(x) == 4 else (k, *x) for k, x in enumerate(rows)]
    return spark.createDataFrame(full, ISSUE)


def report(n, body=BODY, at="2026-04-10T05:00:00Z"):
    return (f"{digest.ISSUE_PREFIX} {n}", f"https://t.example/{n}", at, body)


def test_bodies(spark):
    row = digest.parse_bodies(issues(spark, report(1), report(2, ""))).orderBy("number").collect()
    a, b = row[0]["findings"]
    assert (row[0].report_title, row[0].listed_date, row[0].page_publish_date) == ("Steam (big) market", "May 1", "unknown")
    assert (a["title"], a["category"], a["source"], a["confidence"], a["explanation"]) == ("Years differ", "numeric_inconsistency", "rule", 0.98, "They differ.")
    assert (a["uploader_summary"], a["correction_instruction"], a["evidence"]) == ("Numbers are off.", "Please align.", ["one", "two"])
    assert (b["title"], b["category"], b["confidence"], b["explanation"], b["evidence"]) == ("Old one", "unknown", 0.0, "Wrong company here", [])
    assert row[1]["findings"] == [] and row[1].report_title == "Unknown report"


def test_bodies_come_back_as_written(spark):
    audited = rules.rule_findings(page(spark, page_title="x - 2035"))
    new = render.new_issues(audited).first()
    assert new["title"] == f"{digest.ISSUE_PREFIX} {BASE['card_title']}"
    parsed = digest.parse_bodies(issues(spark, report(1, new["body"])))
    assert parsed.first()["findings"] == audited.first()["findings"]
    assert render.rewritten(parsed).first()["rendered"] == new["body"]


def test_digest(spark):
    held = issues(spark, report(1), report(2), report(3, ""), ("other", "u", "", "x"), (f"{digest.ISSUE_PREFIX} 4", "p", "", BODY, "open", "{}"), (f"{digest.ISSUE_PREFIX} 5", "c", "", BODY, "closed", None))
    body = api.digest(held).first()["body"]
    assert "- Open report issues: 3\n- Unique correction groups: 2\n- Unique findings: 2\n" in body
    assert body.index("## Correction Group 1\nCopy-paste fix for upload team: Please align.\nAffected findings: 1") < body.index("## Correction Group 2\nCopy-paste fix for upload team: Please replace the incorrect company")
    assert "  - one\n  - two" in body and "not captured" in body
    assert api.digest(issues(spark, report(9, ""))).first()["body"].endswith("There is nothing to correct at present.\n")
    assert api.digest_action(held, digest.DIGEST_TITLE).first()["action"] == "create"
    same = issues(spark, report(1), (digest.DIGEST_TITLE, "d", "", api.digest(issues(spark, report(1))).first()["body"]))
    assert api.digest_action(same, digest.DIGEST_TITLE).first()["action"] == "noop"
    assert api.backfill(issues(spark, report(1))).count() == 1


def test_days(spark):
    rows = [report(1, at="2026-04-09T18:29:59Z"), report(2, at="2026-04-09T18:30:00Z"), report(3, at="2026-04-10T18:29:59Z"), report(4, at="2026-04-10T18:30:00Z")]
    day = dt.date(2026, 4, 10)
    body = api.daily(issues(spark, *rows), day, "Asia/Calcutta", "r").first()["body"]
    assert body.startswith("# Report audit daily summary for April 10, 2026\n\n- Time zone: Asia/Calcutta\n- Repository: r\n- Reports with issues: 2\n- Total findings: 4\n")
    assert body.index("t.example/3") < body.index("t.example/2")
    assert api.daily(issues(spark), day).first()["body"].endswith("Nothing was reported on this day.\n")
    # A day of 23 hours.
    short = issues(spark, *(report(k, at=x) for k, x in enumerate(("2026-03-08T05:00:00Z", "2026-03-09T03:59:59Z", "2026-03-09T04:00:00Z"))))
    assert digest.of_day(short, F.lit(dt.date(2026, 3, 8)), "America/New_York").count() == 2


def cards(spark, *urls):
    return spark.createDataFrame([(u, u, "", "", k) for k, u in enumerate(urls)], "title string, url string, summary string, published_on string, pos long")


def test_poll_keeps_state(spark, tmp_path):
    path, out = str(tmp_path / "state"), str(tmp_path / "out")
    audit = lambda chosen: chosen.select("url", F.col("title").alias("card_title"), F.lit("").alias("h1"), F.lit("").alias("page_title"), F.lit("").alias("card_published_on"), F.lit("").alias("publish_date"), F.array().cast(FINDINGS).alias("findings"))
    go = lambda *urls, **settings: poll.poll(spark, cards(spark, *urls), path, audit, out, state.Poll(**settings))
    assert go("a", "b") == poll.Outcome(True, 0, 0)
    assert go("a", "b", "c", "d", "e", max_new=2).audited == 2
    # What was beyond the cap is taken up by the next poll.
    assert go("a", "b", "c", "d", "e", max_new=2).audited == 1
    assert go("a", force_url="z").audited == 1 and go("a", "z").audited == 1
    assert go("a", "b", audit_initial=True, max_new=9).audited == 2
    known, seen = tables.seen_state(spark, path)
    assert known and {r.url for r in seen.collect()} == {"a", "b", "c", "d", "e", "z"}
    assert json.load(open(f"{out}/latest_run.json")) == [] and "No glaring report issues" in open(f"{out}/latest_run.md").read()
    assert state.evicted(seen, 2).count() == 2


def test_poll_publishes_what_is_missing(spark, tmp_path):
    sent = []
    held = issues(spark, (f"{digest.ISSUE_PREFIX} {BASE['card_title']}", "u", "", "old"))
    audit = lambda chosen: rules.rule_findings(page(spark, page_title="x - 2035"))
    publish = lambda new: sent.extend(r.title for r in digest.missing_issues(new, held).collect())
    done = poll.poll(spark, cards(spark, "a"), str(tmp_path / "s"), audit, str(tmp_path / "o"), state.Poll(audit_initial=True), publish=publish)
    assert done.with_issues == 1 and sent == []
    assert [r.action for r in digest.upsert_actions(spark.createDataFrame([("t", "b")], "title string, body string"), held).collect()] == ["create"]


def test_stream_of_cards(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, urls in enumerate((["a", "b"], ["b", "c"])):
        cards(spark, *urls).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(cards(spark).schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    audit = lambda chosen: rules.rule_findings(page(spark)).limit(0)
    q = poll.poll_stream(stream, str(tmp_path / "state"), audit, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.url for r in tables.seen_state(spark, str(tmp_path / "state"))[1].collect()} == {"a", "b", "c"}
    days = poll.day_counts(spark.createDataFrame([(dt.datetime(2026, 1, 1, 20),)], "created_at timestamp"), "Asia/Calcutta").first()
    assert days["day"] == dt.date(2026, 1, 2)


class Web(BaseHTTPRequestHandler):
    def do_GET(self):
        where, _, page_number = self.path.partition("?")
        if where == "/feed":
            card = f'<div class="rep_div"><h3><a href="/r{page_number}">R{page_number}</a></h3></div><div class="rep_div"><h3><a href="/same">S</a></h3></div>'
            body = json.dumps({"reports": card})
        elif where == "/issues":
            made = {"1": [{"number": 2, "title": "b", "created_at": "2026-02-01T00:00:00Z", "body": None}], "2": [{"number": 1, "title": "a", "created_at": "2026-01-01T00:00:00Z", "pull_request": {}}]}
            body = json.dumps(made.get(page_number, []))
        else:
            body = "<h1>x</h1>" if where != "/gone" else ""
        self.send_response(404 if where == "/gone" else 200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *x):
        pass


@pytest.fixture(scope="module")
def web():
    server = HTTPServer(("127.0.0.1", 0), Web)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_live_sources(spark, web):
    http.register(spark)
    feed = spark.read.format("report_feed").option("url", web + "/feed?{page}").option("pages", 2).load()
    got = tables.cards_of(feed).orderBy("pos").collect()
    assert [r.url for r in got] == ["/r1", "/same", "/r2"]
    read = lambda **o: spark.read.format("tracker_issues").options(url=web + "/issues?{page}", **o).load().collect()
    assert [r.number for r in read()] == [2, 1] and [r.number for r in read(since="2026-02-02")] == [2]
    assert read()[1].pull_request == "{}" and read()[0].body == ""
    assert tables.fetched_pages(cards(spark, web + "/p")).first()["html"] == "<h1>x</h1>"
    with pytest.raises(Exception, match="404"):
        tables.fetched_pages(cards(spark, web + "/gone")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "map.xml").write_text("<urlset><url><loc> https://x.example/r/steam-traps </loc></url><url><loc>https://x.example/r/steam-traps</loc></url><url><loc></loc></url></urlset>")
    (tmp_path / "two.xml").write_text("<urlset><loc>https://x.example/r/a-b/</loc></urlset>")
    scan = lambda: tables.sitemap_urls(spark, str(tmp_path / "map.xml"), str(tmp_path / "two.xml"))
    now = dt.datetime(2026, 1, 2, tzinfo=dt.UTC)
    cache = str(tmp_path / "index")
    got = tables.cached_index(spark, cache, scan, now).orderBy("pos").collect()
    assert [(r.title, r.singular_title) for r in got] == [("steam traps", "steam trap"), ("a b", "b")]
    never = lambda: pytest.fail("scanned")
    assert tables.cached_index(spark, cache, never, now + dt.timedelta(hours=24)).count() == 2
    assert tables.cached_index(spark, cache, lambda: scan().limit(1), now + dt.timedelta(hours=24, seconds=1)).count() == 1
    assert not tables.fresh("", now) and not tables.fresh("soon", now) and tables.fresh("2026-01-01T00:00:00Z", now)
    assert tables.seen_state(spark, str(tmp_path / "none"))[0] is False
    (tmp_path / "page.html").write_text(HTML)
    assert tables.saved_pages(spark, str(tmp_path / "page.html")).first()["html"] == HTML
    (tmp_path / "p1.json").write_text(json.dumps({"reports": "<div class=rep_div><h3><a href=a>A</a></h3></div>"}))
    assert tables.cards_of(tables.saved_payloads(spark, str(tmp_path / "p1.json"))).first()["url"] == "a"
    (tmp_path / "issues.json").write_text(json.dumps([{"number": 1, "title": "t", "pull_request": {"a": 1}}]))
    assert tables.saved_issues(spark, str(tmp_path / "issues.json")).first()["pull_request"] is not None
    assert spark.createDataFrame([], SEEN).count() == 0


class Post:
    def __init__(self, *x, **y):
        self.done = []
        Post.last = self

    def __enter__(self):
        return self

    def __exit__(self, *x):
        pass

    def __getattr__(self, name):
        return lambda *x: self.done.append(name)


def test_settings_and_mail():
    config = Config.from_env({"AUDIT_SMTP_HOST": "h", "AUDIT_SMTP_PORT": "25", "AUDIT_SUMMARY_EMAIL_TO": "a@b.c", "AUDIT_SUMMARY_EMAIL_FROM": "a@b.c", "AUDIT_SMTP_STARTTLS": "no", "AUDIT_REVIEWER_KEY": " ", "AUDIT_SMTP_USERNAME": "u"})
    assert config.smtp_port == 25 and config.reviewer_key is None and not config.smtp_starttls and config.request_timeout == 30
    day = dt.date(2026, 4, 10)
    assert sinks.mail(config, day, "text", 1, Post)["Subject"].endswith("(Asia/Calcutta, 1 report issue)")
    assert Post.last.done == ["ehlo", "login", "send_message"]
    with pytest.raises(ValueError, match="smtp_host"):
        sinks.mail(Config(summary_email_to="a", summary_email_from="b"), day, "", 2, Post)
    assert poll_arguments([]).max_new == 25 and summary_arguments(["--dry-run"]).dry_run


def test_numbers_without_one_task_for_all(spark):
    from auditloom.operators.numbering import numbered

    keys = [None, "", "a", "B", "é", "z" * 5000, "\U0001f600", "￮", *(f"same beginning {k % 97} {k}" for k in range(600))]
    want = {k: n for n, k in enumerate(sorted(keys, key=lambda x: (x is not None, (x or "").encode())), 1)}
    rows = spark.createDataFrame([(k, len(k or "")) for k in keys], "key string, size int").repartition(5)
    for bounds in (1, 7, 255, 5000):
        got = numbered(rows, "key", "number", bounds).collect()
        assert len(got) == len(keys) and {r.key: r.number for r in got} == want and all(r.size == len(r.key or "") for r in got)
    assert numbered(rows.limit(0), "key", "number").count() == 0
    assert [r.number for r in numbered(rows.filter("key is null"), "key", "number").collect()] == [1]


def test_tables_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """One file of one row group is dealt over more tasks the more rows it has."""
    from auditloom.operators import numbering
    from auditloom.plans import queries

    spark.range(3000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(numbering, "TASK_ROWS", 100)
    sizes = [r["n"] for r in queries.customer_issues(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 30 and max(sizes) < 200


def test_backfill_parses_a_body_once(spark):
    """The condition on the new body does not parse and write bodies a second time."""
    issues = spark.createDataFrame([(f"{digest.ISSUE_PREFIX} x", "# Alert\n\n### One (a, b, confidence 0.9)\nwhy", 1, "open", None, "u")], "title string, body string, number long, state string, pull_request string, html_url string")
    plan = api.backfill_actions(issues)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("## Findings") == 1 and plan.count() == 1


def test_strip_takes_the_same_white_space_off(spark):
    from auditloom.functions import text as t

    made = spark.createDataFrame([(chr(k),) for k in range(0x3100)], "c string").select(F.concat("c", "c", F.lit("x c"), "c").alias("s"))
    old = F.regexp_replace("s", rf"^{t.WS}+|{t.WS}+$", "")
    assert made.filter(t.strip(F.col("s")) != old).count() == 0


def test_exact_pages_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """One file of one row group is dealt over more tasks the more rows it has, before the trees are read."""
    from auditloom.operators import numbering
    from auditloom.plans import queries

    spark.range(900).select(F.col("id").alias("p_partkey"), F.lit("steam trap").alias("p_name"), F.lit("b").alias("p_brand")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(numbering, "TASK_ROWS", 100)
    assert queries.q30_exact_pages(spark, str(tmp_path)).rdd.getNumPartitions() >= 9


def test_groups_are_counted_without_sorting_findings(spark):
    issues = spark.createDataFrame([("t", "u", "h", "x")], "report_title string, report_url string, html_url string, title string").select("report_title", "report_url", "html_url", "title", F.array().cast(FINDINGS).alias("findings"))
    assert "Window" not in digest.digest_counts(issues)._jdf.queryExecution().optimizedPlan().toString()


def test_flags_match_findings_without_their_entries(spark):
    """Whether a title is twice needs neither windows nor entries; with blank titles, plurals, equal urls and null."""
    from auditloom.operators import titles

    rows = [(f"u{k % 17}" if k % 13 else None, ["steam trap", "steam traps", "valve", "", "valves", "pump", None][k % 7] if k % 5 else f"single {k}", k) for k in range(60)] + [("", "valve", 99)]
    index = titles.with_title_keys(spark.createDataFrame(rows, "url string, title string, pos int"), F.col("title"))
    for unique, known in ((False, index), (True, titles.first_per(index.filter("url <> ''"), "url"))):
        want = titles.duplicates(index, known, unique).select("pos", F.col("match").isNotNull().alias("titles")).collect()
        got = titles.has_duplicate(index, known, unique)
        assert sorted(got.select("pos", "titles").collect()) == sorted(want) and {r.titles for r in want} == {True, False}
    assert "Window" not in titles.has_duplicate(index, index, True)._jdf.queryExecution().optimizedPlan().toString()


def test_title_keys_are_dealt_by_rows(spark):
    from auditloom.operators import titles

    index = titles.with_title_keys(spark.createDataFrame([(f"u{k}", f"title {k // 2}{'s' * (k % 2)}", k) for k in range(300)], "url string, title string, pos int"), F.col("title"))
    want = sorted(titles.duplicates(index, index).select("pos", "match").collect())
    found = titles.duplicates(index, index, dealt_over=40)
    assert sorted(found.select("pos", "match").collect()) == want and found.rdd.getNumPartitions() == 40


def test_places_of_a_large_group_are_numbered_by_many_tasks(spark):
    """One key with nearly all rows, and ties of the first column; numbers and places are those of a sort."""
    from auditloom.operators.numbering import placed

    keys = [("hot" if k % 50 else f"key {k % 7}", f"t{k % 3}", k) for k in range(2000)]
    keys += [("a", None, -1), ("a", "t", -2)]
    rows = spark.createDataFrame(keys, "key string, title string, at int").repartition(5)
    numbers = {k: n for n, k in enumerate(sorted({k for k, _, _ in keys}), 1)}
    want, seen = {}, {}
    for key, title, at in sorted(keys, key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2])):
        seen[key] = seen.get(key, 0) + 1
        want[at] = (numbers[key], seen[key])
    for bounds, dealt_over in ((1, None), (7, 3), (255, 64), (5000, 4)):
        got = placed(rows, "key", ["title", "at"], "number", "place", dealt_over, bounds).collect()
        assert len(got) == len(keys) and {r["at"]: (r.number, r.place) for r in got} == want
    plan = placed(rows, "key", ["title", "at"], "number", "place", 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [_stretch" in plan
    assert placed(rows.limit(0), "key", ["title", "at"], "number", "place").count() == 0
