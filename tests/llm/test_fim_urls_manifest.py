"""Fill-in-middle, URL filters and the manifest, against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from auditloom.llm import fill_middle, manifest, url_filter

SENTINELS = ("<P>", "<S>", "<M>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def arranged(doc_id, text, rate=100, spm_rate=50, seed=7):
    """n, form, prefix, middle, suffix and output, by the definition."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return len(units), form, p, m, s, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


ODD_TEXTS = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\r\nb\r\n", " \t", "é\U0001f600\nß\n", "x <P> y\nz", "<S>", "a<M>\n", "<p>\n<", "P>\n<S\n>M", "a\\Eb\nc\\Q", "$1\n\\n", "one two\n"]


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 100), (0, 50)])
def test_arrangements_against_python(documents, rate, spm_rate):
    draw = random.Random(3)
    rows = [(k, x) for k, x in enumerate(ODD_TEXTS)]
    rows += [(100 + k, "".join(draw.choice("ab é\U0001f600\n<PSM>") for _ in range(draw.randrange(60)))) for k in range(80)]
    rows += [(7, "again\nand\nagain"), (7, "again\nand\nagain"), (None, "no\nid\nat\nall"), (-5, "below\nzero")]
    rows += [(500, "word " * 200_000), (501, "line\n" * 100_000)]  # one very long line, very many lines
    got = fill_middle.arrange(documents(rows), rate, spm_rate).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    names = ["doc_id", "text", "n", "form", "prefix", "middle", "suffix", "output", "back"]
    want = [(i, t or "", *arranged(i, t, rate, spm_rate), t or "") for i, t in rows]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(want, key=repr)


def test_arrangements_of_nothing(documents):
    assert fill_middle.digest(fill_middle.arrange(documents([]))).collect() == []


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "x"), ("<P>", "P", "<M>")])
def test_sentinels_that_could_not_be_read_back(marks):
    with pytest.raises(ValueError, match="sentinels"):
        fill_middle.checked(marks)


# --- urls

URL_COLUMNS = "page_id long, url string, html string, host string, items string, rule string, `index` int, bad int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*x, None, "h", None, "r", 1, 2) for x in rows], URL_COLUMNS).repartition(3)


def parts(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2]) if found else ("", "")


def listed(url, rules):
    host, path = parts(url)
    fit = [r for r in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=len, default=None)


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "HTTP://A.Example.COM/en/x", "http://example.com/en", "http://example.com/en/",
    "http://www.example.com/en/?q", "http://xexample.com/en/", "http://x.net?/es/", "http://x.net/es/", "http://net/fr/#a", "http://net/FR/", "http://a.com://b.net/es/",
    "ftp://u:p@x.net:80/es/", "http://x.net./es/", "http://..com/", "http://é.com/é\n/ü", "http://a.b.c.d.e.f.net/es/" + "x/" * 2000, "://com/x", "http://x.org/" + "y" * 100_000,
]


def test_listed_urls_against_python(spark):
    more = {"com/": "block", "a.com/b": "allow", "b.a.com/": "block", "a.com/bb/": "allow", "c.a.com/b/": "block"}
    draw = random.Random(1)
    urls = ODD_URLS + [f"http://{'.'.join(draw.choices('abc', k=draw.randrange(3)))}{draw.choice(['.', ''])}{draw.choice(['a.com', 'com', 'com.a'])}/{'/'.join(draw.choices(['b', 'bb', 'c'], k=draw.randrange(3)))}{draw.choice(['', '/'])}" for _ in range(200)]
    nothing = spark.createDataFrame([], "antecedent array<string>, confidence double, support long, `index` string")
    for rules in (url_filter.LIST, more):
        got = url_filter.judge(pages_of(spark, list(enumerate(urls)) + [(0, urls[7])]), nothing, rules).collect()
        want = [(k, u, *parts(u), r, rules.get(r, "allow"), None, None) for k, u in [*enumerate(urls), (0, urls[7])] for r in [listed(u, rules)]]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def tokens(url):
    host, path = parts(url)
    found = re.search(r"^[^?#]*\?([^#]*)", url or "")
    segments = [x for x in path.split("/") if x]
    if not path.endswith("/"):
        segments = segments[:-1]
    end = re.search(r"\.([A-Za-z0-9]+)$", path)
    said = [f"h:{x}" for x in host.split(".") if x] + ["p:#" if re.fullmatch("[0-9]+", x) else f"p:{x}" for x in segments]
    said += [f"e:{end[1]}"] if end else []
    return {*said, *(f"q:{y}" for x in (found[1] if found else "").split("&") if (y := x.split("=")[0]))}


def mined(rows, min_support, min_rows, min_confidence, common):
    """Every set of tokens of a labelled url, counted."""
    rows = [(tokens(u), b) for u, b in rows if u is not None and b is not None]
    least = max(min_support * len(rows), min_rows)
    seen = {t: sum(t in x for x, _ in rows) for x, _ in rows for t in x}
    kept = {t for t, n in seen.items() if least <= n <= common * len(rows)}
    counts = {}
    for x, bad in rows:
        own = sorted(x & kept)
        for k in range(1, len(own) + 1):
            for some in itertools.combinations(own, k):
                c = counts.setdefault(some, [0, 0])
                c[0], c[1] = c[0] + 1, c[1] + bool(bad)
    rules = {s: (b / n, b) for s, (n, b) in counts.items() if b >= least and b / n >= min_confidence}
    return {s: v for s, v in rules.items() if not any({*o} < {*s} and c >= v[0] for o, (c, _) in rules.items())}, seen


def planted(draw, n):
    """Urls of which those of two hosts, and those of one directory with one parameter, are bad nearly always."""
    for _ in range(n):
        host = draw.choice(["pills.example", "farm.example", "news.example", "blog.example"]) + draw.choice([".org", ".eu"])
        folder, query = draw.choice(["en", "de", "12", "cheap"]), draw.choice(["", "?ref=1", "?utm=a&ref=2", "#x"])
        bad = host.startswith(("pills", "farm")) or folder == "cheap" and "ref" in query
        yield f"https://{draw.choice(['www.', 'm.', ''])}{host}/{folder}/{draw.randrange(99)}{draw.choice(['', '.html', '/'])}{query}", bad != (draw.random() < 0.03)


def test_mined_rules_against_every_subset(spark):
    rows = list(planted(random.Random(5), 600)) + [(None, True), ("http://x", None), ("", False), ("odd", True)]
    options = {"min_support": 0.01, "min_rows": 8, "min_confidence": 0.9, "common": 0.95}
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean"), **options)
    want, seen = mined(rows, *options.values())
    got = {tuple(r["antecedent"]): r for r in rules.collect()}
    assert got.keys() == want.keys() and ("h:pills",) in got and ("h:farm",) in got and ("p:cheap", "q:ref") in got
    for s, r in got.items():
        assert (r["confidence"], r["support"]) == pytest.approx(want[s]) and r["index"] == min(s, key=lambda t: (seen[t], t))
    # New urls, each once and repeated, are blocked where a rule's tokens are all there.
    new = [u for u, _ in planted(random.Random(6), 150)] + [u for u in ODD_URLS if u is None or "://" not in u]
    judged = {(r["page_id"], r["verdict"], r["mined"]) for r in url_filter.judge(pages_of(spark, [*enumerate(new), *enumerate(new)]), rules).collect()}
    for k, url in enumerate(new):
        fit = sorted((-want[s][0], -want[s][1], list(s)) for s in want if {*s} <= tokens(url))
        assert (k, "block" if fit else "allow", " ".join(fit[0][2]) if fit else None) in judged
    assert len(judged) == len(new)
    # Of urls that nothing was learned from, those of bad hosts are blocked and those of good ones aren't.
    assert {v for k, v, _ in judged if new[k] and "pills" in new[k]} == {"block"} and {v for k, v, _ in judged if new[k] and "news" in new[k] and "cheap" not in new[k]} == {"allow"}


def test_urls_without_labels(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    rules = url_filter.mine(none)
    assert rules.collect() == [] and url_filter.judge(pages_of(spark, []), rules).collect() == []
    good = spark.createDataFrame([("http://a.org/x/1", False)] * 40, "url string, bad boolean")
    assert url_filter.mine(good).collect() == []


def test_labels_of_urls(spark):
    pages = pages_of(spark, [(1, "http://x.net/es/1"), (2, "http://x.org/1"), (3, "http://x.org/2"), (4, "http://x.org/3"), (None, None), (2, "http://x.org/1")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, None), (4, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, url_filter.labelled(pages, labels).collect()))
    assert got == [("http://x.net/es/1", True), ("http://x.org/1", True), ("http://x.org/1", True), ("http://x.org/2", False)]


# --- manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha("".join(map(field, (*row[:-1], text))))


def risen(nodes):
    """The root of nodes and, for each, what stands beside it on every level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, path in enumerate(paths):
            run = level[at[k] // 16 * 16 : at[k] // 16 * 16 + 16]
            path.append(("".join(run[: at[k] % 16]), "".join(run[at[k] % 16 + 1 :])))
        level, at = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)], [k // 16 for k in at]
    return level[0], paths


def by_hand(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    low = lambda x: x and re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), x)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[-1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: risen([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, over = risen([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, over, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            node = leaf(r, low(r[-1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for before, after in path + up:
                node = sha(before + node + after)
            out.append((r[0], own, trees[s][0], root, sha("".join(b + a for b, a in path + up)), node, node == root))
    return sorted(out, key=repr)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "n") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, `key` string, `rank` int, node string").repartition(3)


def some_rows(draw, sizes):
    for source, n in sizes.items():
        for _ in range(n):
            doc_id = draw.choice([draw.randrange(3000), draw.randrange(-(2**62), 2**62)])
            yield doc_id, source, draw.choice([None, "en", "dé"]), draw.choice([None, 3, -1]), draw.choice([None, "", "Ab", "É\U0001f600 Z", "plain"])


SIZES = [
    {"a": 1},
    {"a": 16, None: 17, "": 1, "b": 2},
    {"hot": 300, "é": 33, "\U0001f600": 256, "￿": 4, "Z": 257},
    {f"https://a.very.long.common.beginning.example/{k:03}": 1 + k % 3 for k in range(40)},
]


@pytest.mark.parametrize("sizes", SIZES, ids=range(len(SIZES)))
def test_manifest_against_python(spark, sizes):
    rows = list(some_rows(random.Random(len(sizes)), sizes))
    assert sorted((tuple(r)[:7] for r in manifest.verified(table_of(spark, rows)).collect()), key=repr) == by_hand(rows)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_manifest_of_odd_rows(spark, monkeypatch, bucket):
    """Repeated ids, repeated rows, null ids and sources, the greatest and least ids; longest prefixes of a few rows go on to the digits of the leaf, and of the row."""
    monkeypatch.setattr(manifest, "BUCKET", bucket)
    rows = [(5, "a", "en", 1, "Same")] * 20 + [(5, "a", "en", 1, f"Other {k}") for k in range(20)]
    rows += [(None, "a", None, None, f"T{k % 4}") for k in range(12)] + [(k, None, "en", 1, "x") for k in (2**63 - 1, -(2**63), 0, -1, 255, 256)]
    rows += [(7, "long", "en", 1, "Very Long " * 100_000), (10, "A", "en", 2, "ab"), (15, "A", "en", 2, "AB")]
    assert sorted((tuple(r)[:7] for r in manifest.verified(table_of(spark, rows)).collect()), key=repr) == by_hand(rows)


def test_manifest_of_nothing(spark):
    assert manifest.verified(table_of(spark, [])).collect() == []


def test_tampering_is_found_by_its_place(spark):
    rows = [(k, f"s{k % 3}", "en", 1, "Text" if k % 2 else "text") for k in range(100)]
    got = {r["doc_id"]: r["verified"] for r in manifest.verified(table_of(spark, rows)).collect()}
    touched = {k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert {k for k, ok in got.items() if not ok} == {k for k in touched if k % 2}


def test_ranks_against_sorting(spark):
    draw = random.Random(2)
    rows = [(g, "".join(draw.choices("0123456789ABCDEF", k=draw.choice([14, 20, 30])))) for g in "xy" for _ in range(300)] + [("z", f"{k:020X}") for k in range(0, 70_000 * 40, 70_000)]
    rows = list({*rows})
    got, _ = manifest.ranked(spark.createDataFrame([(g, k, k) for g, k in rows], "`group` string, `key` string, held string"))
    want = {(g, k): (i, len(own)) for g in "xyz" for own in [sorted(k for h, k in rows if h == g)] for i, k in enumerate(own)}
    assert {(r["group"], r["held"]): (r["rank"], r["n"]) for r in got.collect()} == want
