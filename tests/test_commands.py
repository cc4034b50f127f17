import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from auditloom import api, commands
from auditloom.config import Config
from auditloom.functions.text import local_today
from auditloom.operators import review
from auditloom.operators.digest import DIGEST_TITLE, ISSUE_PREFIX


@pytest.fixture
def tracker():
    """A tracker of issues on this machine that also serves a feed of one page; requests holds what was sent to it."""
    issues, requests = [], []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, value):
            raw = json.dumps(value).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self.answer({"reports": ""} if self.path.startswith("/feed") else issues if "page=1&" in self.path else [])

        def do_POST(self):
            requests.append((self.command, self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers["Authorization"]))
            self.answer({})

        do_PATCH = do_POST

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    env = {"AUDIT_TRACKER_URL": base, "AUDIT_TRACKER_TOKEN": "t", "AUDIT_TRACKER_REPOSITORY": "o/r", "AUDIT_FEED_URL": f"{base}/feed?page={{page}}&n={{records}}"}
    yield issues, requests, env
    server.shutdown()


OLD_BODY = "- Report: A\n- URL: https://x.example/a\n\n## Findings\n\n### Numbers (numeric_inconsistency, rule, confidence 0.95)\nwhy\n\nEvidence:\n- one\n"


def issue(number, title=f"{ISSUE_PREFIX} A", body=OLD_BODY, created="2026-04-10T03:00:00Z"):
    return {"number": number, "title": title, "html_url": f"https://t.example/{number}", "created_at": created, "body": body, "state": "open"}


def test_digest_command(spark, tracker):
    issues, requests, env = tracker
    issues += [issue(1), issue(2, DIGEST_TITLE, "old")]
    line = commands.digest_command([], env, spark)
    assert line == "Rewrote 1 issues; digest update."
    assert [(how, path) for how, path, *_ in requests] == [("PATCH", "/repos/o/r/issues/1"), ("PATCH", "/repos/o/r/issues/2")]
    assert all(token == "Bearer t" and list(body) == ["body"] for *_, body, token in requests)
    assert "Please verify the market values" in requests[0][2]["body"] and requests[1][2]["body"].startswith("# Open correction digest")


def test_summary_command(spark, tracker, tmp_path):
    issues, _, env = tracker
    issues += [issue(1), issue(2, created="2026-04-01T00:00:00Z")]
    path = tmp_path / "day.md"
    line = commands.summary_command(["--date", "2026-04-10", "--output-path", str(path), "--dry-run"], env, spark)
    assert "1 report issues" in line and path.read_text().startswith("# Report audit daily summary for April 10, 2026")
    with pytest.raises(ValueError, match="tracker_token"):
        commands.summary_command(["--dry-run"], {}, spark)


def test_poll_command_of_an_empty_feed(spark, tracker, tmp_path):
    _, requests, env = tracker
    line = commands.poll_command(["--pages", "1", "--state-path", f"{tmp_path}/state", "--artifacts-path", f"{tmp_path}/out"], env, spark)
    assert line.startswith("Remembered") and not requests
    again = commands.poll_command(["--pages", "1", "--state-path", f"{tmp_path}/state", "--artifacts-path", f"{tmp_path}/out"], env, spark)
    assert again == "Audited 0 new reports, 0 with findings."


def test_creations(spark):
    held = spark.createDataFrame([(1, "a", "open", None), (2, "b", "closed", None)], "number long, title string, state string, pull_request string")
    new = spark.createDataFrame([("a", "x"), ("b", "y")], "title string, body string")
    assert [tuple(r) for r in api.creations(new, held).collect()] == [("b", "y", None, "create")]


def test_reviewer():
    schema = review.response_schema()
    categories = schema["properties"]["findings"]["items"]["properties"]["category"]["enum"]
    assert categories == sorted(review.CATEGORY_WORDS) and review.reviewer(Config()) is None
    assert review.reviewer(Config(reviewer_key="k", reviewer_url="http://x")) is not None


def test_today_of_a_zone():
    now = dt.datetime(2026, 4, 9, 20, 0, tzinfo=dt.UTC)
    assert local_today("Asia/Calcutta", now) == dt.date(2026, 4, 10) and local_today("UTC", now) == dt.date(2026, 4, 9)


def test_index_is_looked_up_for_every_batch(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(commands, "cached_index", lambda *a, **_: asked.append(a[1]))
    monkeypatch.setattr(commands, "fetched_pages", lambda cards, timeout: cards)
    monkeypatch.setattr(commands.api, "audit", lambda pages, index: pages)
    audit = commands.fresh_audit(spark, str(tmp_path), ["a.xml"])
    cards = spark.createDataFrame([("t", "u", "s", "p", 1)], "title string, url string, summary string, published_on string, pos long")
    assert audit(cards).count() == 1 and audit(cards).count() == 1 and len(asked) == 2


