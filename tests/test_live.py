"""Live sources and sinks, against a server on this machine."""

import datetime as dt
import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from auditloom import api, commands
from auditloom.config import Config
from auditloom.operators import review, state
from auditloom.operators.digest import ISSUE_PREFIX
from auditloom.sources import http, sinks, sitemaps, tables
from auditloom.sources.versions import Versions
from auditloom.streaming import poll
from auditloom.streaming import state as streams


class Site:
    """Files by path, a feed's cards (newest first) in pages, a tracker's issues, a reviewer; asked holds the paths asked for, sent what was posted."""

    def __init__(self):
        self.files, self.feed, self.per_page, self.issues, self.asked, self.sent = {}, [], 2, [], [], []
        self.reviews, self.fail = {}, {}
        self.lock = threading.Lock()

    def page(self, items, query, size):
        k = int(query["page"][0])
        return items[(k - 1) * size : k * size]

    def get(self, path, query):
        if path == "/feed":
            cards = "".join(f'<div class="rep_div"><h3><a href="{u}">{t}</a></h3><div class="info_content"><p>S</p></div><div class="date_box">May 01, 2026</div></div>' for t, u in self.page(self.feed, query, self.per_page))
            return json.dumps({"reports": cards}).encode()
        if path == "/repos/o/r/issues":
            of_state = [x for x in self.issues if query["state"][0] in ("all", x["state"])]
            return json.dumps(self.page(sorted(of_state, key=lambda x: x["created_at"], reverse=True), query, 3)).encode()
        return self.files.get(path)

    def post(self, method, path, body):
        if path == "/review":
            answer = self.reviews.get(json.loads(body["input"][1]["content"])["report"]["url"], {"should_alert": False, "summary": "", "findings": []})
            return {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": json.dumps(answer)}]}]}
        with self.lock:
            if method == "POST":
                self.issues.append({"number": len(self.issues) + 1, "title": body["title"], "body": body["body"], "state": "open", "created_at": "2026-05-01T00:00:00Z", "html_url": "h"})
            else:
                next(x for x in self.issues if x["number"] == int(path.rpartition("/")[2])).update(body)
        return {}


@pytest.fixture
def site():
    it = Site()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, raw):
            self.send_response(code)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            it.asked.append(self.path)
            parts = urlsplit(self.path)
            raw = it.get(parts.path, parse_qs(parts.query))
            self.answer(404, b"") if raw is None else self.answer(200, raw if isinstance(raw, bytes) else raw.encode())

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            it.sent.append((self.command, self.path, body))
            done = json.dumps(it.post(self.command, self.path, body)).encode()
            key = (self.command, self.path, body.get("title"))
            left = it.fail.get(key) or it.fail.get((self.command, self.path), [])
            # What fails here has been done, but the answer says otherwise.
            self.answer(left.pop(0) if left else 200, done)

        do_PATCH = do_POST

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    it.base = f"http://127.0.0.1:{server.server_port}"
    yield it
    server.shutdown()


def urlset(*urls, tag="urlset", of="url", more=""):
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<!-- <loc>no</loc> --><{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://x.example/i">' + "".join(f"<{of}><loc>\n {u} </loc><lastmod>2026</lastmod>{more}</{of}>" for u in urls) + f"</{tag}>"


def test_sitemaps(spark, site, tmp_path):
    at = lambda x: f"{site.base}/{x}"
    site.files |= {
        "/a.xml": urlset("http://x/r/1", "http://x/r/2?a=1&amp;b=2", more="<image:image><image:loc>http://x/no.png</image:loc></image:image>"),
        "/b.xml.gz": gzip.compress(urlset("http://x/r/3", "http://x/r/1").encode()) + gzip.compress(b"<!-- another member -->"),
        "/index.xml": urlset(at("c.xml"), at("d.xml"), at("c.xml"), at("index2.xml"), tag="sitemapindex", of="sitemap"),
        "/c.xml": "<urlset><loc><![CDATA[http://x/r/5&6]]></loc></urlset>",
        "/d.xml": "<urlset>" + "".join(f"<url><loc>http://x/d/{k}</loc></url>" for k in range(5000)) + "<url>& broken <loc>http://x/r/7</LOC><LOC >http://x/r/8</loc></urlset>",
        "/index2.xml": urlset(at("e.xml"), at("index2.xml"), at("index.xml"), tag="sitemapindex", of="sitemap"),
        "/e.xml": urlset("http://x/r/9"),
        "/empty.xml": urlset(),
    }
    (tmp_path / "saved.xml").write_text(urlset("http://x/r/10", ""))
    paths = [at("a.xml"), at("b.xml.gz"), str(tmp_path / "saved.xml"), at("index.xml"), at("empty.xml")]
    got = [r["url"] for r in sitemaps.sitemap_urls(spark, *paths).orderBy("pos").collect()]
    want = ["http://x/r/1", "http://x/r/2?a=1&b=2", "http://x/r/3", "http://x/r/1", "http://x/r/10", "http://x/r/5&6", *(f"http://x/d/{k}" for k in range(5000)), "http://x/r/7", "http://x/r/8", "http://x/r/9"]
    # The index within an index lists the outer one again, whose sitemaps come in its place; no sitemap is read twice for one partition.
    assert got[: len(want)] == want and {*got} == {*want}
    index = tables.title_index(sitemaps.sitemap_urls(spark, *paths))
    first = {r["url"]: r["pos"] for r in index.collect()}
    assert len(first) == len({*want}) and sorted(first, key=first.get) == list(dict.fromkeys(want))
    assert spark.read.format("sitemap").options(urls=f"{at('a.xml')} {at('index.xml')}").load().rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="404"):
        sitemaps.sitemap_urls(spark, at("gone.xml")).collect()


def test_a_sitemap_is_read_as_it_comes():
    whole = urlset(*(f"http://x/{k}" for k in range(20_000))).encode()
    taken = []

    def chunks():
        for k in range(0, len(whole), 1000):
            taken.append(k)
            yield whole[k : k + 1000]

    told = sitemaps.located(chunks)
    assert next(told) == (False, "") and next(told)[1].strip() == "http://x/0" and len(taken) < 3
    assert len(list(told)) == 19_999
    for size in (1, 3, 1 << 20):
        raw = gzip.compress(b"ab" * 1000) + gzip.compress(b"c")
        assert b"".join(sitemaps.plain(raw[k : k + size] for k in range(0, len(raw), size))) == b"ab" * 1000 + b"c"
    assert b"".join(sitemaps.plain([b"x"])) == b"x" and list(sitemaps.entries(lambda: [b""], 1)) == []


PAGE = "<html><head><title>{0} - 2035</title></head><body><h1>{0} (2026 - 2036)</h1></body></html>"


def settings(site):
    return {
        "AUDIT_FEED_URL": f"{site.base}/feed?page={{page}}&n={{records}}",
        "AUDIT_SITEMAPS": f"{site.base}/a.xml {site.base}/index.xml",
        "AUDIT_TRACKER_URL": site.base,
        "AUDIT_TRACKER_TOKEN": "t",
        "AUDIT_TRACKER_REPOSITORY": "o/r",
        "AUDIT_REVIEWER_URL": f"{site.base}/review",
        "AUDIT_REVIEWER_KEY": "k",
        "AUDIT_REVIEWER_MODEL": "m",
    }


def filled(site):
    """A feed of four cards of which two pages have findings of the rules, and one has one of the reviewer's."""
    names = ["steam-trap-market", "valve-market", "pump-market", "hose-market"]
    site.feed = [(x.replace("-", " ").title(), f"{site.base}/r/{x}") for x in names]
    for title, url in site.feed:
        site.files[urlsplit(url).path] = PAGE.format(title) if "Steam" in title else PAGE.format(title).replace("2035", "2036")
    site.files |= {"/a.xml": urlset(f"{site.base}/old/valve-markets"), "/index.xml": urlset(f"{site.base}/c.xml", tag="sitemapindex", of="sitemap"), "/c.xml": urlset(f"{site.base}/r/pump-market")}
    said = {"category": "company_name_error", "title": "Wrong company", "explanation": "The company name is wrong", "uploader_summary": "s", "correction_instruction": "Please fix", "confidence": 0.97, "evidence": ["e"]}
    site.reviews[site.feed[2][1]] = {"should_alert": True, "summary": "", "findings": [said]}


def test_poll_command_from_feed_to_issues(spark, site, tmp_path):
    filled(site)
    arguments = ["--pages", "2", "--state-path", f"{tmp_path}/state", "--artifacts-path", f"{tmp_path}/out"]
    go = lambda *more: commands.poll_command([*arguments, *more], settings(site), spark)
    assert go("--audit-initial", "--max-new", "3") == "Audited 3 new reports, 3 with findings."
    assert sorted(x["title"] for x in site.issues) == [f"{ISSUE_PREFIX} {t}" for t in ("Pump Market", "Steam Trap Market", "Valve Market")]
    assert [x["url"] for x in json.load(open(f"{tmp_path}/out/latest_run.json"))] == [u for _, u in site.feed[:3]]
    assert next(x for x in site.issues if "Pump" in x["title"])["body"].count("Wrong company") == 1
    asked = [p for how, p, _ in site.sent if p == "/review"]
    assert len(asked) == 3 and site.sent[0][2]["text"]["format"]["strict"] and site.sent[0][2]["input"][0]["role"] == "system"
    # The same pages again: nothing is created, and the reviewer isn't asked again.
    assert go("--audit-initial", "--max-new", "3") == "Audited 3 new reports, 3 with findings."
    assert len(site.issues) == 3 and len([p for _, p, _ in site.sent if p == "/review"]) == 3
    # The card beyond the cap is taken up by the next poll, and then there is nothing new.
    assert go() == "Audited 1 new reports, 0 with findings." and go() == "Audited 0 new reports, 0 with findings."
    assert sum(x.startswith("/c.xml") for x in site.asked) == 1


def test_follow_command(spark, site, tmp_path):
    filled(site)
    new, site.feed = site.feed[:3], site.feed[3:]
    arguments = ["--pages", "1", "--state-path", f"{tmp_path}/state", "--artifacts-path", f"{tmp_path}/out", "--max-new", "2"]
    go = lambda: commands.follow_command(arguments, settings(site), spark)
    go()
    assert site.issues == [] and not (tmp_path / "out").exists()  # the first look fills the seen set
    site.feed = new + site.feed
    go()
    assert {x["title"] for x in site.issues} == {f"{ISSUE_PREFIX} {t}" for t in ("Steam Trap Market", "Valve Market")}
    site.feed = [("Late", f"{site.base}/r/hose-market?late")] + site.feed
    site.files["/r/hose-market"] = PAGE.format("Late")
    go()
    # The newest card first, then the one that waited.
    assert {x["title"] for x in site.issues[2:]} == {f"{ISSUE_PREFIX} {t}" for t in ("Late", "Pump Market")}
    go()
    assert len(site.issues) == 4


def shown(spark, site, tmp_path, **options):
    """Runs the stream of cards over what is new, and gives the titles in order of batches."""
    http.register(spark)
    out = str(tmp_path / "rows")
    cards = spark.readStream.format("report_cards").options(url=f"{site.base}/feed?page={{page}}", log=str(tmp_path / "log"), pages="1", **options).load()
    query = cards.writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [r["title"] for r in spark.read.schema("look long, page int, position int, title string, pos long").json(out).orderBy("look", "page", "position").collect()]


def test_stream_of_a_feed_neither_loses_nor_repeats_cards(spark, site, tmp_path):
    cards = [(f"R{k}", f"http://x/{k}") for k in range(12)]
    site.feed = [cards[1], cards[0]]
    assert shown(spark, site, tmp_path) == ["R1", "R0"]
    assert shown(spark, site, tmp_path) == ["R1", "R0"]
    # More new cards than fit on a page: the look pages on until it meets one that it knows; one is listed twice.
    site.feed = [*cards[6:1:-1], cards[5], cards[1], cards[0]]
    assert shown(spark, site, tmp_path) == ["R1", "R0", "R6", "R5", "R4", "R3", "R2"]
    # A run that fails after its look was logged: the next one reads the log, though the feed has moved on.
    log = http.LookLog(str(tmp_path / "log"))
    reader = http.CardReader({"url": f"{site.base}/feed?page={{page}}", "log": str(tmp_path / "log"), "pages": "1"})
    site.feed = [cards[7], *site.feed]
    lost = reader.latestOffset()
    assert lost == {"look": 3, "page": 1, "position": 0} and log.looks()[-1] == 3
    site.feed = [cards[9], cards[8], *site.feed]
    # availableNow takes one look a run: first what was logged, then what is new since.
    assert shown(spark, site, tmp_path)[7:8] == ["R7"] and shown(spark, site, tmp_path)[7:] == ["R7", "R9", "R8"]
    assert len(shown(spark, site, tmp_path)) == 10
    site.feed = []
    assert len(shown(spark, site, tmp_path)) == 10


def test_offsets_of_a_feed_in_small_batches(site, tmp_path):
    site.feed = [(f"R{k}", f"http://x/{k}") for k in range(5)]
    options = {"url": f"{site.base}/feed?page={{page}}", "log": f"file://{tmp_path}/log", "pages": "3", "cards": "2"}
    reader, at, got = http.CardReader(options), {"look": 0, "page": 0, "position": 0}, []
    for _ in range(4):
        reader = http.CardReader(options)  # as after a restart
        end = reader.latestOffset()
        batch = [row[4] for x in reader.partitions(at, end) for row in reader.read(x)]
        assert batch == [row[4] for x in reader.partitions(at, end) for row in reader.read(x)]
        got.append(batch)
        reader.commit(end)
        at = end
    assert got == [["http://x/0", "http://x/1"], ["http://x/2", "http://x/3"], ["http://x/4"], []]


def cards(spark, *urls):
    return spark.createDataFrame([(u, u, "", "", k) for k, u in enumerate(urls)], "title string, url string, summary string, published_on string, pos long")


LISTS = [["m", "c", "a"], ["z", "k", "m", "j", "c", "b", "a"], ["q", "z", "z", "k", "", "j", "b"], ["j", "b", "y", "x"], ["b", "a", "w", "x", "m"]]


def by_polls(spark, lists, keep, **options):
    """The admitted urls of each poll, by the functions that polls use."""
    seen, known, out = spark.createDataFrame([], "url string"), False, []
    for urls in lists:
        now, settings_ = cards(spark, *urls), state.Poll(**options)
        chosen = [r["url"] for r in state.admitted(now, seen, known, settings_).orderBy("pos").collect()]
        new = state.remembered(now, cards(spark, *chosen), seen, known, settings_)
        seen = spark.createDataFrame(state.evicted(new, keep).collect(), "url string")
        known = True
        out.append(chosen)
    return out


@pytest.mark.parametrize(("keep", "options"), [(5000, {"max_new": 2}), (3, {"max_new": 2}), (5000, {"max_new": 2, "audit_initial": True}), (4, {"max_new": 25})])
def test_admission_as_state_is_that_of_polls(spark, tmp_path, keep, options):
    """Five batches with a restart, each holding what the feed lists at the time; cards that wait stay listed until they are admitted."""
    streams.with_state(spark)
    (tmp_path / "in").mkdir()
    got = []

    def note(rows, number):
        got.append([r["url"] for r in rows.collect()])

    def run(lists):
        for k, urls in lists:
            cards(spark, *urls).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
            stream = spark.readStream.schema(cards(spark).schema).json(str(tmp_path / "in/*"))
            writer = streams.admissions(stream, state.Poll(**options), keep).writeStream.foreachBatch(note)
            writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run(enumerate(LISTS))
    want = by_polls(spark, LISTS, keep, **options)
    assert got == want
    if options == {"max_new": 2} and keep > 5:
        assert want[1:4] == [["z", "k"], ["q", "j"], ["b", "y"]]


def test_cards_that_wait_come_without_a_batch(spark, tmp_path):
    streams.with_state(spark)
    (tmp_path / "in").mkdir()
    got = []
    for k, urls in enumerate([["a"], ["e", "d", "c", "b", "a"]]):
        cards(spark, *urls).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(cards(spark).schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    query = streams.admissions(stream, state.Poll(max_new=3), again=0.5).writeStream.foreachBatch(lambda rows, k: got.extend(r["url"] for r in rows.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    end = dt.datetime.now() + dt.timedelta(seconds=60)
    while len(got) < 4 and dt.datetime.now() < end and query.isActive:
        query.awaitTermination(1)
    query.stop()
    assert got == ["e", "d", "c", "b"]


def test_days_close_at_midnight_of_their_zone(spark, tmp_path):
    """Days of 23 and of 25 hours, rows that are late within and beyond the delay."""
    streams.with_state(spark)
    (tmp_path / "in").mkdir()
    batches = [
        ["2026-03-08 04:59:59", "2026-03-08 05:00:00", "2026-03-09 03:59:59", "2026-03-09 04:30:00"],  # 8 March has 23 hours in New York
        ["2026-03-09 03:40:00", "2026-03-09 05:10:00", "2026-11-01 03:59:00", "2026-11-01 04:00:00", "2026-11-02 04:59:59", "2026-11-02 06:30:00"],  # 1 November has 25
        ["2026-03-08 06:00:00", "2026-11-05 00:00:00", None],
    ]
    got = []
    for k, times in enumerate(batches):
        rows = [(None if x is None else dt.datetime.fromisoformat(x).replace(tzinfo=dt.UTC),) for x in times]
        spark.createDataFrame(rows, "created timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema("created timestamp").parquet(str(tmp_path / "in/*"))
        query = streams.closed_days(stream, "America/New_York").writeStream.foreachBatch(lambda rows, k: got.extend(map(tuple, rows.collect()))).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()
    days = {str(d): (n, h) for d, n, h in got}
    assert len(days) == len(got)
    assert days == {"2026-03-07": (1, 24), "2026-03-08": (3, 23), "2026-03-09": (2, 24), "2026-10-31": (1, 24), "2026-11-01": (2, 25), "2026-11-02": (1, 24)}


def test_a_task_that_runs_again_creates_each_issue_once(spark, site, tmp_path):
    """The third creation is done and then reported as failed, so that its task runs again where Spark retries tasks, or the whole write is repeated."""
    config = Config(tracker_url=site.base, tracker_token="t", tracker_repository="o/r")
    site.issues += [{"number": 1, "title": "t1", "state": "open", "created_at": "2026-01-01T00:00:00Z", "body": "old"}, {"number": 2, "title": "t2", "state": "open", "created_at": "2026-01-01T00:00:00Z", "body": "", "pull_request": {}}]
    rows = [(f"t{k}", "b", None, "create") for k in range(1, 9)] + [("t3", "b", None, "create"), ("x", "new", 1, "update"), ("y", "b", None, "noop")]
    actions = spark.createDataFrame(rows, "title string, body string, number long, action string")
    site.fail[("POST", "/repos/o/r/issues", "t5")] = [500]
    with pytest.raises(Exception, match="500"):
        sinks.write_actions(actions, config, receipt=f"{tmp_path}/one")
    assert json.load(open(tmp_path / "one.json"))["whole"] is False
    done = sinks.write_actions(actions, config, receipt=f"{tmp_path}/two")
    assert done == {"create": 9, "update": 1, "noop": 1}
    opened = [x["title"] for x in site.issues if "pull_request" not in x]
    assert sorted(opened) == [f"t{k}" for k in range(1, 9)] and site.issues[0]["body"] == "new"
    told = json.load(open(tmp_path / "two.json"))
    assert told["whole"] and told["updated"] == 1 and told["created"] + told["there"] == 9
    with pytest.raises(Exception, match="overwrit"):
        actions.write.format("tracker_issues").mode("overwrite").options(base=site.base).save()


def test_filters_on_issues_are_pushed(spark, site):
    site.issues += [{"number": k, "title": f"t{k}", "state": "open" if k % 2 else "closed", "created_at": f"2026-01-{k:02}T00:00:00{'Z' if k % 3 else '+05:30'}", "body": None} for k in range(1, 16)]
    site.issues += [{"number": 99, "title": "odd", "state": "open", "created_at": "", "body": None}]
    config = Config(tracker_url=site.base, tracker_token="t", tracker_repository="o/r")

    def read(condition):
        site.asked.clear()
        found = commands.tracker_issues(spark, config).filter(condition)
        plan = found._jdf.queryExecution().executedPlan().toString()
        return sorted(r["number"] for r in found.collect()), len({*site.asked}), plan

    numbers, pages, _ = read(F.lit(True))
    assert numbers == [*range(1, 16), 99] and pages == 7
    numbers, pages, plan = read("state = 'open'")
    assert numbers == [1, 3, 5, 7, 9, 11, 13, 15, 99] and all("state=open" in x for x in site.asked) and " Filter (" not in plan
    since = F.col("created") >= F.lit(dt.datetime(2026, 1, 13, tzinfo=dt.UTC))
    numbers, pages, plan = read(since)
    assert numbers == [13, 14, 15] and pages == 2 and " Filter (" not in plan
    numbers, pages, _ = read(since & (F.col("created") < F.lit(dt.datetime(2026, 1, 15, tzinfo=dt.UTC))) & F.col("title").startswith("t"))
    # The fifteenth was made at half past six of the day before, in UTC.
    assert numbers == [13, 14, 15] and pages == 2
    numbers, _, _ = read("state = 'open' and state = 'closed'")
    assert numbers == []
    numbers, _, _ = read("state in ('open', 'x') and number > 9")
    assert numbers == [11, 13, 15, 99]


def test_two_polls_at_once_lose_no_url(spark, tmp_path):
    path, gate, errors = str(tmp_path / "seen"), threading.Barrier(3), []

    def save(name):
        try:
            gate.wait()
            for k in range(3):
                _, seen = tables.seen_state(spark, path)
                sinks.save_seen(spark, seen.union(spark.createDataFrame([(f"{name}{k}",)], "url string")), path, keep=100)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=save, args=(x,)) for x in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    known, seen = tables.seen_state(spark, path)
    assert not errors and known and {r["url"] for r in seen.collect()} == {f"{x}{k}" for x in "abc" for k in range(3)}
    versions = Versions(spark, path)
    assert versions.numbers() == list(range(1, 10))
    versions.tidy(keep=1, age=dt.timedelta(0))
    assert versions.numbers() == [9] and tables.seen_state(spark, path)[1].count() == 9
    assert not versions.claim(9, {}) and versions.claim(10, {"table": "x"}) and versions.read(10) == {"table": "x"}


def test_claims_on_a_file_system_without_links(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "t"))
    versions.local = False
    assert versions.claim(1, {"a": 1}) and not versions.claim(1, {"a": 2}) and versions.read(1) == {"a": 1}


def test_answers_are_kept_by_content(spark, tmp_path):
    path, asked = str(tmp_path / "answers"), tmp_path / "asked"
    asked.write_text("")

    def make():
        def review_(prompt):
            with open(asked, "a") as f:
                f.write(prompt + "\n")
            if prompt == "bad" and asked.read_text().count("bad") < 2:
                raise OSError("busy")
            return json.dumps({"said": prompt})

        return review_

    prompts = spark.createDataFrame([("u1", "one"), ("u2", "two"), ("u3", "one"), ("u4", "bad")], "url string, prompt string")
    with pytest.raises(RuntimeError, match="failed on 1 pages.*busy"):
        review.reviews(prompts, path, make)
    got = {r["url"]: json.loads(r["response"])["said"] for r in review.reviews(prompts, path, make).collect()}
    assert got == {"u1": "one", "u2": "two", "u3": "one", "u4": "bad"}
    # Each prompt once, the failed one again.
    assert sorted(asked.read_text().split()) == ["bad", "bad", "one", "two"]
    review.reviews(prompts, path, make).collect()
    assert len(asked.read_text().split()) == 4
    # Other settings, such as another model, are other questions.
    review.reviews(prompts.limit(1), path, make, "other").collect()
    assert len(asked.read_text().split()) == 5


def test_reviewer_protocol(site):
    config = Config(reviewer_key="k", reviewer_url=f"{site.base}/review", reviewer_model="m")
    site.fail[("POST", "/review")] = [503, 429]
    ask = review.reviewer(config, (0, 0))()
    prompt = json.dumps({"report": {"url": "u"}})
    assert json.loads(ask(prompt)) == {"should_alert": False, "summary": "", "findings": []} and len(site.sent) == 3
    site.fail[("POST", "/review")] = [400]
    with pytest.raises(OSError, match="400"):
        ask(prompt)
    site.fail[("POST", "/review")] = [503, 503, 503]
    with pytest.raises(OSError, match="503"):
        ask(prompt)
    assert review.reply_text({"choices": [{"message": {"content": "{}"}}]}) == "{}" and review.reply_text({"should_alert": True}) == '{"should_alert": true}'
