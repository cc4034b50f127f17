import itertools
import math
import random
import time

import pytest

from auditloom.llm import html_extract, tiling

TEXT = "Some long paragraph of the article, with enough words to count as text."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{TEXT}<p>Two &amp; more\n\n  words</article><footer>foot</footer>", f"T\n{TEXT}\nTwo & more words"),
        (f"<body><header><h2>Site</h2></header><div id=main-content><h1>T</h1><div class=text><p>{TEXT}</p><p>{TEXT}</p></div></div><div class='comments'><p>{TEXT} {TEXT} {TEXT}</p></div>", f"T\n{TEXT}\n{TEXT}"),
        (f"<article><header><h1>T</h1></header><p>{TEXT}</p><form>f<input></form><aside>a</aside><div class='ad'>{TEXT}</div><script>if (a < b) '</p>'</script><style>p{{}}</style></article>", f"T\n{TEXT}"),
        (f"<div class=sidebar><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div><div role=navigation>{TEXT}</div><main><p>{TEXT}<br>next <b>bold</b>ly</p><ul><li>one<li>two</ul></main>", f"{TEXT} next boldly\none\ntwo"),
        ("<p>a<!-- b --></p><p title='x>y'>c &lt;d&gt; &#233;</p>", "a\nc <d> é"),
        ("plain", "plain"),
        ("<a", "<a"),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(page, text):
    got = html_extract.main_text(page)
    assert got == text or (page == "<a" and got in ("", "<a"))


LONG = " ".join([TEXT] * 6)
SIDE = "".join(f"<p>Short note {k} of the house.</p>" for k in range(12))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class=c2><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class=c1>{SIDE}</div></body>",
        f"<body><div class=c1>{SIDE}</div><div class=c2><div><h1>T</h1><p>{LONG}</p></div><div><p>{LONG}</p></div></div><div class=c3>{SIDE}</div></body>",
        f"<body><div class=c0><div class=c2><h1>T</h1><p><b>{LONG}</b><br></p><p>{LONG}</p></div><div class=c1>{SIDE}</div></div></body>",
        f"<body><article><p>An extract.</p></article><div class=c2><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class=c1>{SIDE}</div></body>",
    ],
)
def test_density_decides_where_no_name_does(page):
    got = html_extract.main_text(page)
    assert "Short note" not in got and got.endswith(f"T\n{LONG}\n{LONG}")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div class='layout with-sidebar'><article><h1>T</h1><p>{LONG}</p></article></div></body>", f"T\n{LONG}"),
        (f"<body><div class='has-banner'><h1>T</h1><p>{LONG}</p></div></body>", f"T\n{LONG}"),
        (f"<body><div class='sidebar'><article><p>{LONG}</p></article></div></body>", LONG),
        (f"<body><div class='sidebar'><p>{LONG}</p></div></body>", LONG),
        (f"<body><article><header class='entry-header'><h1>T</h1></header><p>{LONG}</p></article></body>", f"T\n{LONG}"),
        (f"<body><main><div class='page-header'><h1>T</h1></div><p>{LONG}</p></main></body>", f"T\n{LONG}"),
        (f"<body><div class='site-header'><p>{TEXT}</p></div><main><p>{LONG}</p></main></body>", LONG),
        (f"<body><article><p>{TEXT} <span class='share'>shared</span> word {TEXT}</p></article></body>", f"{TEXT} shared word {TEXT}"),
        (f"<body><article><p>{LONG}</p></article><article><p>{TEXT}</p></article></body>", f"{LONG}\n{TEXT}"),
        (f"<body><article><p>{LONG}</p><div class='cookie-notice'><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div></article></body>", LONG),
        (f"<body><div class=c><p>{LONG}</p><div class='td-ad-rotate'><p><a href=x>Buy now</a></p></div><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
        (f"<body><div class=c><p>{LONG}</p><div class='ad-hoc'><p>{LONG}</p></div></div></body>", f"{LONG}\n{LONG}"),
    ],
)
def test_names_say_no_more_than_they_do(page, text):
    assert html_extract.main_text(page) == text


P, NOTE, MENU = f"<p>{LONG}</p>", f"<p>{TEXT}</p>", "<ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul>"
TABLE = "<table><tr><th>Year</th><th>Sum</th></tr><tr><td>2026</td><td>12</td></tr></table>"
REFERENCES = "<h2>References</h2><ol><li>Doe, <a href=x>A title of a work</a>, 2020</li><li>Roe, <a href=y>Another one</a></li></ol>"
SECTIONS = f"<section><h2>One</h2>{P}{P}</section><section><h2>Two</h2><p>Short.</p></section><section><h2>Three</h2><ul><li>a<li>b</ul></section>"
ROWS, LIST, SOURCES = "Year\nSum\n2026\n12", "a\nb", "References\nDoe, A title of a work, 2020\nRoe, Another one"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article>{SECTIONS}</article>", f"One\n{LONG}\n{LONG}\nTwo\nShort.\nThree\n{LIST}"),
        (f"<article><section>{P}</section><section>{TABLE}</section><section>{P}</section>{REFERENCES}</article>", f"{LONG}\n{ROWS}\n{LONG}\n{SOURCES}"),
        (f"<div class=c9>{SECTIONS}{TABLE}{REFERENCES}</div>", f"One\n{LONG}\n{LONG}\nTwo\nShort.\nThree\n{LIST}\n{ROWS}\n{SOURCES}"),
        (f"<div class=c9>{P}{TABLE}<ul><li>a<li>b</ul>{P}{REFERENCES}</div><div class=c1>{MENU}</div>", f"{LONG}\n{ROWS}\n{LIST}\n{LONG}\n{SOURCES}"),
        (f"<div class=c9><h1>T</h1><div class=by>By <a href=x>Jane</a></div><time>1 May</time><div class=content>{P}{P}</div></div>", f"T\nBy Jane\n1 May\n{LONG}\n{LONG}"),
        (f"<h1>T</h1><div class=by>By Jane</div><p>1 May</p><div class=content>{P}{P}</div><div class=c1>{SIDE}</div>", f"T\nBy Jane\n1 May\n{LONG}\n{LONG}"),
        (f"<main><header class=site-header><p>Site</p></header><div class=lead>A short lead.</div><div class=content>{P}{P}</div><p>The end.</p></main>", f"A short lead.\n{LONG}\n{LONG}\nThe end."),
        (f"<div class=page><div class=top>{MENU}</div><p>A short lead.</p><div class=content>{P}{P}</div><p>The end.</p><div class=b>© 2026 House</div></div>", f"A short lead.\n{LONG}\n{LONG}\nThe end."),
        (f"<div class=row><div class=column>{P}</div><div class=column>{NOTE}</div><div class=column><p>Short.</p></div></div>", f"{LONG}\n{TEXT}\nShort."),
        (f"<div class=page><h1>T</h1><div class=row><div class=content>{P}{P}</div><div class=c1>{SIDE}</div></div></div>", f"T\n{LONG}\n{LONG}"),
        (f"<div class=page><h1>T</h1><article>{P}{P}</article><div class=c3>{SIDE}</div></div>", f"T\n{LONG}\n{LONG}"),
        (f"<div class=c9>Words before. <div class=content>{P}</div> Words after.</div>", f"Words before.\n{LONG}\nWords after."),
        (f"<div class=c9><div class=content>{P}{P}</div><h2>More</h2></div><div class=c1>{SIDE}</div>", f"{LONG}\n{LONG}"),
        (f"<article><h1>T</h1>{P}<div class=reactions>{P}</div></article>", f"T\n{LONG}"),
    ],
)
def test_articles_stay_whole(page, text):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == text


def test_many_siblings_and_ties():
    """Equal blocks, very many: all of them, in order."""
    blocks = [f"<div class=x><p>{k:06} {TEXT}</p></div>" for k in range(20_000)]
    began = time.time()
    got = html_extract.main_text("<body><div>" + "".join(blocks) + "</div></body>").split("\n")
    assert got == [f"{k:06} {TEXT}" for k in range(20_000)] and time.time() - began < 10
    odd = "".join(f"<div class=c{k % 3}><p>{TEXT * (1 + k % 4)}</p><p>a</p></div>" for k in range(5000))
    began = time.time()
    html_extract.main_text(f"<body><div>{odd}</div></body>")
    html_extract.main_text("<p><button>" + "<b>" * 8000 + "<div></div>" * 8000)
    assert time.time() - began < 10


def test_only_what_does_not_belong_is_missing():
    """On random trees: the text is the page's in page order, with all of the densest element, and without dropped ones."""
    rng = random.Random(23)

    def tree(depth):
        name = rng.choice(["div", "section", "ul", "p", "b", "a", "nav", "h2", "article"]) if depth else "div"
        inner = "".join(tree(depth + 1) if depth < 5 and rng.random() < 0.6 else f"w{rng.random()} " * rng.randint(0, 9) for _ in range(rng.randint(1, 4)))
        return f"<{name}>{inner}</{name}>"

    for _ in range(200):
        page = f"<html><body>{tree(0)}{tree(0)}</body></html>"
        root = html_extract.parse(page)
        every = html_extract.without_named(root)
        whole = html_extract.block_text([root]).split()
        inside = [x for x in every if x.name not in html_extract.INLINE and x.chars]
        body = next(x for x in every if x.name == "body")
        core = html_extract.block_text([html_extract.densest(inside, body)[0]]).split() if inside else []
        got = html_extract.main_text(page).split()
        places = [whole.index(x) for x in got]
        assert places == sorted(places) and {*core} <= {*got}


def slow_density(node, share):
    """Composite text density of an element, by walking all that is below it."""
    chars = tags = links = link_tags = 0
    todo = [(node, node.name == "a")]
    while todo:
        x, linked = todo.pop()
        own = sum(len("".join(part.split())) for part in x.parts if isinstance(part, str))
        chars, links = chars + own, links + own * linked
        for child in x.children:
            if not child.dropped:
                tags, link_tags = tags + 1, link_tags + (child.name == "a")
                todo.append((child, linked or child.name == "a"))
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
    return chars / max(tags, 1) * max(math.log(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1)), 0) / base


def test_densities_and_choice_on_random_trees():
    rng = random.Random(17)

    def tree(depth):
        name = rng.choice(["div", "section", "ul", "p", "b", "a", "nav"]) if depth else "div"
        inner = "".join(tree(depth + 1) if depth < 5 and rng.random() < 0.6 else "w" * rng.randint(0, 30) + " " for _ in range(rng.randint(1, 4)))
        return f"<{name}>{inner}</{name}>"

    for _ in range(200):
        root = html_extract.parse(f"<html><body>{tree(0)}{tree(0)}</body></html>")
        every = html_extract.measured(root)
        body = next(x for x in every if x.name == "body")
        walk = lambda x: [x, *(z for y in x.children if not y.dropped for z in walk(y))]
        assert sorted(map(id, walk(root))) == sorted(map(id, every))
        share = body.links / body.chars if body.chars else 0
        for x in every:
            assert x.density == pytest.approx(slow_density(x, share))
            below = [y.density for y in x.children if not y.dropped and y.name not in html_extract.INLINE]
            assert x.sum == pytest.approx(sum(below) or x.density)
        inside = [x for x in every if x.name not in html_extract.INLINE and x.chars]
        if inside:
            top = max(inside, key=lambda x: (x.sum, x.chars))
            path = [x for x in walk(body) if any(y is top for y in walk(x))]
            assert html_extract.path_threshold(top, body) == min(x.density for x in path)
            best = max((x for x in inside if x.density >= min(y.density for y in path)), key=lambda x: (x.sum, x.chars))
            chosen = html_extract.article(root)
            assert any(x is best for top_ in chosen for x in walk(top_))


def test_unmatched_tags_take_linear_time():
    began = time.time()
    html_extract.main_text("<div>" * 20_000 + "</section>" * 20_000 + "x")
    html_extract.main_text("<div>" * 20_000 + "<li>x" * 20_000)
    assert time.time() - began < 10


def test_long_and_deep_pages():
    assert html_extract.main_text("<div>" * 20_000 + "x" * 10) == "x" * 10
    assert len(html_extract.main_text(f"<article><p>{'word ' * 300_000}</p></article>")) == 5 * 300_000 - 1


def test_extract_rows(spark):
    rows = [(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def slow_tiles(doc, item, k):
    """Greedy tiling by trying every start, longest first."""
    marked_d, marked_i, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p, q in itertools.product(range(len(doc)), range(len(item))):
            n = 0
            while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in marked_d and q + n not in marked_i:
                n += 1
            if n > best[0]:
                best = (n, p, q)
        n, p, q = best
        if n < k:
            return out
        marked_d |= set(range(p, p + n))
        marked_i |= set(range(q, q + n))
        out += n


def test_tiling_is_greedy():
    rng = random.Random(2)
    for _ in range(150):
        doc, item = ([rng.choice("abc") for _ in range(rng.randint(1, 25))] for _ in range(2))
        bench = tiling.Benchmark([(7, " ".join(item))], 3)
        got = dict(bench.coverages(" ".join(doc))).get(7, 0.0)
        assert got == pytest.approx(slow_tiles(doc, item, 3) / len(item))


ITEM = "one two three four five. six seven eight nine ten. eleven twelve thirteen fourteen fifteen"


@pytest.mark.parametrize("sent_words", [10**6, 0])
def test_judge(spark, documents, sent_words):
    moved = "x y z Eleven twelve thirteen fourteen fifteen; q six seven eight nine ten r one two three four five"
    docs = documents([(1, ITEM), (2, moved), (3, "one two three four " + "other " * 5000), (4, None), (5, ""), (None, ITEM), (1, ITEM)])
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "short one"), (4, ""), (None, ITEM), (1, "quite another text of this id")], "item_id long, text string")
    got = tiling.judge(docs, bench, sent_words=sent_words)
    found = (True, 2, "1,null")
    assert sorted((r.doc_id or 0, (r.contaminated, r.n_items, r["items"])) for r in got.collect()) == [(0, found), (1, found), (1, found), (2, found), (3, (False, 0, "")), (4, (False, 0, "")), (5, (False, 0, ""))]
    assert got.columns[: len(docs.columns)] == docs.columns
    assert tiling.judge(documents([]), bench, sent_words=sent_words).count() == 0
    assert not any(r.contaminated for r in tiling.judge(docs, bench.limit(0), sent_words=sent_words).collect())


def test_both_ways_agree(spark, documents):
    rng = random.Random(14)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["a " * 700]
    bench = spark.createDataFrame([(k % 15, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 20)))) for k in range(25)], "item_id long, text string")
    key = lambda r: (r.doc_id, r.contaminated, round(r.max_coverage, 12), r.n_items, r["items"])
    sent, joined = (sorted(map(key, tiling.judge(documents(texts), bench, sent_words=n).collect())) for n in (10**6, 0))
    assert sent == joined and any(r[1] for r in sent)


def test_equal_words_take_little():
    """A stretch of a diagonal for every place, not a pair for every two."""
    bench = tiling.Benchmark([(1, "a " * 200), (2, "b c d e")])
    began = time.time()
    assert bench.coverages("a " * 20_000) == [(1, 1.0)]
    assert time.time() - began < 10 and len(bench.seeds("a " * 20_000)[0]) < 20_300
