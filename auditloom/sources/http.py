"""Data sources in Python for paged interfaces: a feed's pages, its new cards as a stream, and a tracker's issues, read and written."""

from __future__ import annotations

import datetime as dt
import json
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.arrow import read_cards

AGENT = "report-audit/1.0"


def fetch(url: str, timeout: float, headers: dict[str, str] | None = None) -> bytes:
    """The body of a url; an answer that is no success raises, and so fails the task and the poll."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept-Language": "en-US,en;q=0.9"} | (headers or {})), timeout=timeout) as answer:
        return answer.read()


class FeedSource(DataSource):
    """Feed payloads: page and reports (markup). Options: url with {page} and {records}, pages, records, timeout."""

    @classmethod
    def name(cls) -> str:
        return "report_feed"

    def schema(self) -> str:
        return "page int, reports string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


class FeedPages:
    def __init__(self, options):
        self.url, self.pages = options["url"], int(options.get("pages", 2))
        self.records, self.timeout = int(options.get("records", 150)), float(options.get("timeout", 30))

    def markup(self, page: int) -> str:
        return json.loads(fetch(self.url.format(page=page, records=self.records), self.timeout))["reports"]


class FeedReader(FeedPages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        yield partition.value, self.markup(partition.value)


class CardSource(DataSource):
    """The new cards of a feed as a stream. Options: those of the feed, log (a shared folder), cards (of a batch at most; none: all).

    A feed can't be asked again for what it showed, so each look at it is written to
    the log before its offset is given out, and batches are read from there. An
    offset is a look, a page and a position: what comes up to it has been read.
    A card is new if the look before didn't hold it; a look pages on, past ``pages``
    if it has to, until it meets a card that the look before held, or an empty page.
    """

    @classmethod
    def name(cls) -> str:
        return "report_cards"

    def schema(self) -> str:
        return "look long, page int, position int, title string, url string, summary string, published_on string, pos long"

    def streamReader(self, schema) -> CardReader:
        return CardReader(self.options)


Place = tuple[int, int, int]


def place_of(offset: dict) -> Place:
    return offset["look"], offset["page"], offset["position"]


class JsonFolder:
    """JSON values by name, one file each, written whole or not at all, on any file system that Arrow reads."""

    def __init__(self, folder: str):
        self.files, self.folder = arrow_fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)

    def read(self, name: str) -> dict | None:
        try:
            with self.files.open_input_stream(f"{self.folder}/{name}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def write(self, name: str, value: dict) -> None:
        part = f"{self.folder}/.{name}.part"
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps(value).encode())
        self.files.move(part, f"{self.folder}/{name}.json")


class LookLog(JsonFolder):
    """Looks by number, and the last offset given out."""

    def looks(self) -> list[int]:
        names = (x.base_name for x in self.files.get_file_info(arrow_fs.FileSelector(self.folder)))
        return sorted(int(x[5:-5]) for x in names if x.startswith("look-") and x.endswith(".json"))

    def look(self, k: int) -> dict:
        return self.read(f"look-{k}") or {"cards": [], "shown": []}

    def keep(self, k: int, look: dict) -> None:
        self.write(f"look-{k}", look)

    def drop(self, k: int) -> None:
        self.files.delete_file(f"{self.folder}/look-{k}.json")


class CardReader(FeedPages, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.folder, self.most = options["log"], int(options.get("cards", 0))
        self.log = LookLog(self.folder)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "log"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.log = LookLog(self.folder)

    def initialOffset(self) -> dict:
        return {"look": 0, "page": 0, "position": 0}

    def looked(self, known: set[str]) -> dict:
        """Another look at the feed: its new cards with page and position, and every url that it showed."""
        cards, shown, page, met = [], {}, 0, not known
        while page < self.pages or not met:
            page += 1
            found = read_cards(self.markup(page))
            for position, x in enumerate(found):
                met = met or x["url"] in known
                if x["url"] and x["url"] not in shown:
                    shown[x["url"]] = True
                    if x["url"] not in known:
                        cards.append([page, position, x["title"], x["url"], x["summary"], x["published_on"]])
            if not found:
                break
        return {"cards": cards, "shown": list(shown)}

    def latestOffset(self) -> dict:
        last = self.log.read("given") or self.initialOffset()
        looks = self.log.looks()
        waiting = self.after(place_of(last), looks)
        if not waiting:
            held = self.log.look(looks[-1]) if looks else {"shown": []}
            new = self.looked(set(held["shown"]))
            if new["cards"]:
                looks.append(looks[-1] + 1 if looks else 1)
                self.log.keep(looks[-1], new)
                waiting = self.after(place_of(last), looks)
        if waiting:
            k, page, position = (waiting[: self.most] if self.most else waiting)[-1]
            last = {"look": k, "page": page, "position": position}
            self.log.write("given", last)
        return last

    def after(self, start: Place, looks: list[int]) -> list[Place]:
        return [x for k in looks if k >= start[0] for c in self.log.look(k)["cards"] if (x := (k, c[0], c[1])) > start]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = place_of(start), place_of(end)
        return [InputPartition((k, a, b)) for k in self.log.looks() if a[0] <= k <= b[0] and a < b]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        k, start, end = partition.value
        for page, position, *card in self.log.look(k)["cards"]:
            if start < (k, page, position) <= end:
                # The feed's order within a look; later looks come after.
                yield k, page, position, *card, k * 1_000_000_000 + page * 100_000 + position

    def commit(self, end: dict) -> None:
        """The last look stays, for what it showed."""
        for k in self.log.looks()[:-1]:
            if k < end["look"]:
                self.log.drop(k)


class IssueSource(DataSource):
    """Issues of a tracker, read page after page until an empty one, newest first, and written.

    Options: base (the url that issues are listed and posted under), or url with {page} and {state} to list them; state
    (open, closed or all), since (ISO time), token, timeout, receipt (a file for what was written, without its .json).
    """

    @classmethod
    def name(cls) -> str:
        return "tracker_issues"

    def schema(self) -> str:
        return "number long, title string, html_url string, created_at string, body string, state string, pull_request string, created timestamp"

    def reader(self, schema) -> IssueReader:
        return IssueReader(self.options)

    def writer(self, schema, overwrite: bool) -> IssueWriter:
        if overwrite:
            raise ValueError("issues can be added and changed; there is no overwriting")
        return IssueWriter(self.options)


def moment(text: str | None) -> dt.datetime | None:
    try:
        at = dt.datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)


class Listing:
    def __init__(self, options):
        self.base = options.get("base")
        self.url = options.get("url") or f"{self.base}?state={{state}}&per_page=100&page={{page}}&sort=created&direction=desc"
        self.token, self.timeout = options.get("token"), float(options.get("timeout", 30))

    def headers(self) -> dict[str, str]:
        return {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})

    def pages(self, state: str) -> Iterator[list[dict]]:
        page = 1
        while items := json.loads(fetch(self.url.format(page=page, state=state), self.timeout, self.headers())):
            yield items
            page += 1


class IssueReader(Listing, DataSourceReader):
    """Filters on state and on the time of creation (column created) are done here: the state is asked for, and pages after one with an older issue aren't."""

    def __init__(self, options):
        super().__init__(options)
        self.state, self.since = options.get("state", "open"), moment(options.get("since"))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for x in filters:
            column = x.attribute[0] if len(x.attribute) == 1 else None
            if isinstance(x, IsNotNull) and column in ("state", "created"):
                self.tests.append((column, "there", None))
            elif column == "state" and isinstance(x, EqualTo) and isinstance(x.value, str):
                self.tests.append((column, "=", x.value))
                if self.state == "all" and x.value in ("open", "closed"):
                    self.state = x.value
            elif column == "created" and type(x) in kinds and isinstance(x.value, dt.datetime):
                value = x.value if x.value.tzinfo else x.value.replace(tzinfo=dt.UTC)
                self.tests.append((column, kinds[type(x)], value))
                if kinds[type(x)] in ("=", ">", ">="):
                    self.since = max(value, self.since or value)
            else:
                yield x

    def fits(self, row: dict) -> bool:
        made: dict[str, Callable] = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "there": lambda a, b: True}
        return all(row[column] is not None and made[kind](row[column], value) for column, kind, value in self.tests)

    def read(self, partition) -> Iterator[tuple]:
        for items in self.pages(self.state):
            times = [moment(x.get("created_at")) for x in items]
            for x, created in zip(items, times, strict=True):
                pull, state = x.get("pull_request"), x.get("state") or ""
                if self.fits({"state": state, "created": created}):
                    yield x.get("number"), x.get("title") or "", x.get("html_url") or "", x.get("created_at") or "", x.get("body") or "", state, None if pull is None else json.dumps(pull), created
            # Newest first: what comes after an older issue is older still.
            if self.since and any(t and t < self.since for t in times):
                return


@dataclass
class Written(WriterCommitMessage):
    created: int = 0
    updated: int = 0
    there: int = 0


class IssueWriter(Listing, DataSourceWriter):
    """Writes actions: title, body, number and action (create, update or noop).

    A task that runs again must not create an issue once more. A title is the key of an
    open issue, so before its first creation every attempt lists the open issues, and
    leaves out what is there. Rows of one title belong into one task; write_actions sees to it.
    An update sets a body, and may be sent twice. What a failed write has sent stays.
    """

    def __init__(self, options):
        super().__init__(options)
        if not self.base:
            raise ValueError("base is needed to write issues")
        self.receipt = options.get("receipt")

    def send(self, method: str, url: str, body: dict) -> None:
        headers = self.headers() | {"User-Agent": AGENT, "Content-Type": "application/json"}
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers, method=method), timeout=self.timeout):
            pass

    def write(self, iterator) -> Written:
        done, held = Written(), None
        for row in iterator:
            if row["action"] == "create":
                if held is None:
                    held = {x.get("title") for items in self.pages("open") for x in items if x.get("pull_request") is None}
                if row["title"] in held:
                    done.there += 1
                    continue
                self.send("POST", self.base, {"title": row["title"], "body": row["body"]})
                held.add(row["title"])
                done.created += 1
            elif row["action"] == "update":
                self.send("PATCH", f"{self.base}/{row['number']}", {"body": row["body"]})
                done.updated += 1
        return done

    def commit(self, messages: list[Written | None]) -> None:
        self.note(messages, True)

    def abort(self, messages: list[Written | None]) -> None:
        """Of tasks that ended, what they sent; issues can't be taken back, and the next write leaves out what is there."""
        self.note(messages, False)

    def note(self, messages: list[Written | None], whole: bool) -> None:
        if self.receipt:
            told = [x for x in messages if x]
            folder, _, name = self.receipt.rpartition("/")
            JsonFolder(folder).write(name, {"whole": whole} | {k: sum(getattr(x, k) for x in told) for k in ("created", "updated", "there")})


def register(spark) -> None:
    for source in (FeedSource, CardSource, IssueSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
