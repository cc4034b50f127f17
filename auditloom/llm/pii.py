"""Personal data in texts: exact patterns, and a character BiLSTM-CRF for what is written in other ways.

The patterns give the base spans (``base_spans``). The tagger is trained on
labelled spans: those that the patterns find in a bounded sample of documents,
and spans in other ways of writing, put into pieces of the sample's text. It
reads every text from its first character to its last in overlapping windows;
each character takes its label from the window that shows most of its
surroundings, and the spans that result are joined over the whole text. A
tagged span counts if it touches no base span and holds what its kind must: a number of digits, a Luhn sum, four small numbers, or
a name, an at, and a domain with a dot; how these are written is the tagger's.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import BiLstmCrf
from .common import add_columns, slices

# Kinds in the order of the contract, and its patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]

LABELS = 1 + 2 * len(KINDS)  # outside, then first and further character of each kind
#: Windows that are read, and how far apart they begin; windows learned from; how much stands around a span that is learned from.
WINDOW, STRIDE, LEARNED, AROUND = 256, 224, 64, 40
#: What stretches without spans are learned from must not hold; it plays no part in reading.
TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?at\s?[\])}>]|\sdot\s", re.I)
OTHER = 96


def digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(number)):
        n = int(x) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def is_card(number: str) -> bool:
    return 13 <= len(number) <= 19 and luhn(number)


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches: an @ with what may stand before it and a dotted domain behind.

    The @ is looked for first, since a search from the left takes the square of the length of a long word.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[Span]:
    """Four numbers joined by points; a longer run of them is taken four by four.

    Every number is matched, with points or without, so that a long one is read once.
    """
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            size = sum(map(len, own)) + 3
            if all(map(small, own)):
                yield "ip", at, at + size
            at += size + 1


def cards(text: str) -> Iterator[Span]:
    return (("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and is_card(digits(m[0])))


def phones(text: str) -> Iterator[Span]:
    return (("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15)


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns, kind by kind and from left to right; matches that fail their test are dropped."""
    return [*emails(text), *addresses(text), *cards(text), *phones(text)]


#: By code point, with one entry for all from 127 on.
NUMBERS = np.array([OTHER - 1] * 32 + list(range(95)) + [OTHER], np.uint8)


def numbers(text: str) -> np.ndarray:
    """A number for each character: printable ASCII has its own, control characters share one, and so does the rest."""
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return NUMBERS[np.minimum(codes, 127)]


def regions(text: str) -> list[tuple[int, int]]:
    """The stretches that are read: every text whole."""
    return [(0, len(text))] if text else []


def windows(start: int, end: int) -> list[int]:
    """Where the windows over a stretch begin; the last one reaches its end."""
    return [start, *range(start + STRIDE, max(start + 1, end - WINDOW + STRIDE), STRIDE)]


def decode(model: BiLstmCrf, texts: list[str], at_once: int = 1024) -> list[np.ndarray]:
    """Labels of every character of each text. A text of any length is read in batches of windows."""
    labels = [np.zeros(len(x), np.int8) for x in texts]
    codes, waiting = np.empty((at_once, WINDOW), np.uint8), []

    def run() -> None:
        for (k, start, first), own in zip(waiting, model.decode(codes[: len(waiting)]) if waiting else [], strict=True):
            labels[k][start + first : start + WINDOW] = own[first : len(labels[k]) - start]
        waiting.clear()

    for k, text in enumerate(texts):
        for start, end in regions(text):
            places = windows(start, end)
            for at, w in enumerate(places):
                if at % 64 == 0:
                    begin, some = w, numbers(text[w : places[min(at + 63, len(places) - 1)] + WINDOW])
                own = some[w - begin : w - begin + WINDOW]
                codes[len(waiting), : len(own)], codes[len(waiting), len(own) :] = own, OTHER - 1
                # Windows come from left to right; up to the middle of the overlap the earlier one has seen more.
                waiting.append((k, w, (WINDOW - STRIDE) // 2 if w > start else 0))
                if len(waiting) == at_once:
                    run()
    run()
    return labels


def tagged(text: str, labels: np.ndarray) -> Iterator[Span]:
    """The spans of a text's labels: a kind's run goes on until its next first character or another label."""
    at = np.flatnonzero(labels)
    start = 0
    while start < len(at):
        kind, end = (labels[at[start]] - 1) // 2, start + 1
        while end < len(at) and at[end] == at[end - 1] + 1 and labels[at[end]] == 2 * kind + 2:
            end += 1
        a, b = int(at[start]), int(at[end - 1]) + 1
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            yield KINDS[kind], a, b
        start = end


SPELT_AT = re.compile(r"\s*(?:@|[\[({<]\s?at\s?[\])}>]|\sat\s)\s*", re.I)
SPELT_DOT = re.compile(r"[A-Za-z0-9]\s?(?:\.|[\[({<]\s?dot\s?[\])}>]|\sdot\s)\s?[A-Za-z0-9]", re.I)
LETTER = re.compile(r"[^\W\d_]")
#: A year, a month and a day with date separators, a time or a further date behind them or not; or nothing but years.
DATED = re.compile(r"(?:19|20)[0-9]{2}([./-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])(?:[\x20._/-]{1,2}[0-9].*)?|(?:19|20)[0-9]{2}(?:[\x20./-]{1,2}(?:19|20)[0-9]{2})+")


def holds(kind: str, text: str) -> bool:
    """Whether a tagged span holds what its kind must, however it is written."""
    number = digits(text)
    if kind == "email":
        parts = SPELT_AT.split(text)
        return len(parts) == 2 and parts[0].isascii() and any(map(str.isalnum, parts[0])) and bool(SPELT_DOT.search(parts[1]))
    if LETTER.search(text.replace("dot", "")):
        return False
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(map(small, parts))
    if kind == "card":
        return is_card(number)
    return 9 <= len(number) <= 15 and not DATED.fullmatch(text)


def alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit continues a span; a piece of a longer token is not personal data by itself."""
    return not (start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum())


def all_spans(text: str, base: list[Span], labels: np.ndarray) -> list[Span]:
    """Base spans and the tagged spans that touch none of them, kind by kind and from left to right."""
    starts, ends = (np.sort(np.array([s[k] for s in base], np.int64)) for k in (1, 2))
    added = []
    for kind, a, b in tagged(text, labels):
        # A base span touches this one if more of them begin before its end than end before its start.
        if np.searchsorted(starts, b) == np.searchsorted(ends, a, "right") and alone(text, a, b) and holds(kind, text[a:b]):
            added.append((kind, a, b))
    return sorted([*base, *added], key=lambda x: (KINDS.index(x[0]), x[1]))


# --- training


def invented(rng: np.random.Generator) -> tuple[str, str]:
    """A kind and one of the ways to write it, or an empty kind and something like it that is none."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    some = lambda n: "".join(pick(*"0123456789") for _ in range(n))
    word = lambda: "".join(pick(*"abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(2, 9))))
    kind = pick("email", "email", "ip", "card", "phone", "")
    if kind == "email":
        at = pick("@", "@", " @ ", "[at]", " [at] ", "(at)", " (at) ", " {at} ", " AT ", " at ", " <at> ")
        dot = "." if at == "@" else pick(" dot ", " DOT ") if at.strip().isalpha() else pick("[dot]", " [dot] ", " (dot) ", "(dot)", " dot ", ".", ".")
        name = f"{word()}{pick('', '', '.', '_', '-', some(2))}"
        name = f"{name}{word()}" if name[-1] in "._-" else name
        end = pick("com", "org", "net", "edu", "de", "fr", "io", "info", word()[:3])
        domain = [f"{word()}{pick('', '', some(1), some(2), '-' + word())}" for _ in range(pick(1, 1, 2, 2, 3))]
        written = dot.join([*domain, end])
        return kind, f"{name.title() if rng.random() < 0.15 else name}{at}{written}"
    if kind == "ip":
        return kind, pick(".", "[.]", "(.)", " . ", ", ", " dot ", "[dot]").join(str(int(rng.integers(0, 256))) for _ in range(4))
    if kind == "card":
        number = some(15)
        number += next(x for x in "0123456789" if luhn(number + x))
        return kind, pick("", "", " ", "-", ".", "  ", " - ", "_", "/").join(number[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c, d = str(int(rng.integers(1, 99))), some(3), some(3), some(4)
        return kind, pick(f"+{a} ({b}) {c}-{d}", f"+{a} {b} {c} {d}", f"+{a}{b}{c}{d}", f"({b}) {c}-{d}", f"{b}-{c}-{d}", f"{b}.{c}.{d}", f"00{a} {b} {c} {d}", f"0{b}/{c}{d}", f"+{a}-{b}-{c}-{d}")
    hexa = "".join(pick(*"0123456789abcdef") for _ in range(int(rng.integers(8, 41))))
    return "", pick(hexa, f'token = "{hexa}"', some(4), f"{some(1)}.{some(1)}.{some(2)}", f"20{some(2)}-0{pick(*'123456789')}-1{some(1)}", f"{some(2)}:{some(2)}:{some(2)}", f"{some(3)},{some(3)}", f"v{some(1)}.{some(2)}", f"${some(2)}.{some(2)}", f"@{word()}", f"{some(2)}%", f"{some(5)}", word())


def apart(base: list[Span], size: int) -> list[Span]:
    """Of the base spans of a text of this size those that no earlier one overlaps: kinds may overlap, the tagger learns the first."""
    taken, out = np.zeros(size, bool), []
    for kind, a, b in base:
        if not taken[a:b].any():
            out.append((kind, a, b))
        taken[a:b] = True
    return out


def stretches(text: str) -> Iterator[tuple[str, list[Span]]]:
    """Every stretch of a text to learn from: those around its base spans, with the spans in them, and those without any trigger."""
    base = apart(base_spans(text), len(text))
    order = sorted(base, key=lambda x: x[1])
    firsts = [a for _, a, _ in order]
    for _, a, b in order:
        start, end = max(0, a - AROUND), min(len(text), b + AROUND)
        own = order[bisect.bisect_left(firsts, start) : bisect.bisect_left(firsts, end)]
        yield text[start:end], [(kind, x - start, min(y, end) - start) for kind, x, y in own]
    for start in range(0, len(text), 2 * LEARNED):
        piece = text[start : start + 2 * LEARNED]
        if len(piece) > 20 and not TRIGGER.search(piece):
            yield piece, []


def examples(pieces: list[tuple[str, list[Span]]], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character numbers and labels: n with invented spans in pieces without spans, and one of each piece with some."""
    rng = np.random.default_rng(seed)
    plain = [x for x, spans in pieces if not spans] or ["the of and to in that is for with on as by at from "]
    xs, ys = [], []

    def add(text: str, spans: list[Span], start: int) -> None:
        y = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            y[a:b] = 2 * KINDS.index(kind) + 2
            y[a] -= 1
        start = max(0, min(start, len(text) - 1))
        x, y = numbers(text)[start : start + LEARNED], y[start : start + LEARNED]
        xs.append(np.pad(x, (0, LEARNED - len(x)), constant_values=OTHER - 1))
        ys.append(np.pad(y, (0, LEARNED - len(y))))

    for _ in range(n):
        own = plain[int(rng.integers(len(plain)))]
        cut = int(rng.integers(0, len(own)))
        before, after = own[max(0, cut - LEARNED) : cut], own[cut : cut + LEARNED]
        kind, text = invented(rng)
        before = before if not before or rng.random() < 0.1 else before.rstrip() + (" ", "\n", " (", ": ")[int(rng.integers(4))]
        after = (" ", ", ", ". ", "\n", ") ")[int(rng.integers(5))] + after
        spans = [(kind, len(before), len(before) + len(text))] if kind else []
        add(before + text + after, spans, len(before) - int(rng.integers(0, LEARNED - 16)))
    for text, spans in pieces:
        if spans:
            add(text, spans, int(rng.integers(0, AROUND)))
    return np.stack(xs), np.stack(ys)


def sample(docs: DataFrame, rows: int, pieces: int) -> list[tuple[str, list[Span]]]:
    """Up to ``pieces`` stretches with base spans and as many without, of up to ``rows`` documents, half of them with a digit.

    Documents are those of the smallest hash of id and text, stretches those of the smallest hash among all of theirs.
    """
    known = docs.select("doc_id", "text").filter(F.length("text") > 20).withColumn("key", F.xxhash64("doc_id", "text"))
    with_digits = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    keys = [r["key"] for part in (with_digits, ~with_digits) for r in known.filter(part).select("key").orderBy("key").limit(rows // 2).collect()]
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sorted(set(keys))], "key long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for text in batch.column("text").to_pylist():
                own = list(stretches(text))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array([written(s) for _, s in own], pa.string())], ["piece", "spans"])

    cut = known.join(chosen, "key", "left_semi").select("text").mapInArrow(run, "piece string, spans string").distinct().withColumn("key", F.xxhash64("piece", "spans"))
    found = [r for some in (F.col("spans") != "", F.col("spans") == "") for r in cut.filter(some).orderBy("key", "piece").limit(pieces).collect()]
    return [(r["piece"], read(r["spans"])) for r in found]


def train(docs: DataFrame, rows: int = 300, pieces: int = 600, invented_windows: int = 8000, epochs: int = 7, seed: int = 5) -> BiLstmCrf:
    """A tagger trained on labelled spans: those that the patterns find in a bounded sample, and invented ones put into its text (see sample)."""
    x, y = examples(sample(docs, rows, pieces), invented_windows, seed)
    model, rng = BiLstmCrf(OTHER + 1, LABELS), np.random.default_rng(seed)
    for epoch in range(epochs):
        for ids in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            model.step(x[ids], y[ids], 0.012 if epoch < epochs - 2 else 0.004)
    return model


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def read(spans: str) -> list[Span]:
    return [(kind, int(a), int(b)) for kind, a, b in (x.split(":") for x in spans.split(",") if x)]


def find(docs: DataFrame, model: BiLstmCrf) -> DataFrame:
    """The columns of docs, and n_email, n_ip, n_card, n_phone (base spans), base_spans and spans of every row, repeated ones too; null counts as empty, and a long text is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(values: list[str | None]) -> list[tuple]:
        texts = [x or "" for x in values]
        base = [base_spans(x) for x in texts]
        found = [all_spans(*x) for x in zip(texts, base, decode(shared.value, texts), strict=True)]
        return [(*(sum(s[0] == k for s in b) for k in KINDS), written(b), written(a)) for b, a in zip(base, found, strict=True)]

    return add_columns(docs, "text", run, "n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def masked(text: str | None, spans: str) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the one that begins first holds both."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(read(spans), key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: BiLstmCrf) -> DataFrame:
    """Replaces the spans found in the column text; the other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(values: list[str | None]) -> list[tuple]:
        texts = [x or "" for x in values]
        labels = decode(shared.value, texts)
        return [(masked(x, written(all_spans(x or "", base_spans(x or ""), y))),) for x, y in zip(values, labels, strict=True)]

    return add_columns(docs, "text", run, "text string", drop=True).select(*docs.columns)

