import html
import re

import pytest

from conflictlake.llm import wrappers as X

TOP = '<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">'
NAV = '<nav><ul><li><a href="/a>b">Home</a></li><li><a href=x>News</a></li></ul></nav><!-- <article><p>no</p></article> -->'
NOISE = ['<div class="ad">buy %d</div>', '<aside>side %d</aside>', '<form><p>mail %d</p></form>', '<div id="cookie-notice"><p>we use %d</p></div>', '<div class="sidebar"><p>links %d</p></div>',
         '<section class="comments"><article class="comment"><p>first! %d</p></article></section>', '<header><h2>Site %d</h2></header>', '<div role="navigation">to %d</div>', '<noscript><p>js %d</p></noscript>']


def page(i: int, article: str) -> str:
    before = "".join(n % i for k, n in enumerate(NOISE) if (i + k) % 3 == 0)
    inside = "".join(n % i for k, n in enumerate(NOISE[:5]) if (i + k) % 4 == 0)
    after = "".join(n % i for k, n in enumerate(NOISE) if (i + k) % 2 == 0)
    end = "</body></html>" if i % 5 else ""
    return f"{TOP}{NAV}{before}<article>{article.replace('@', inside)}</article>{after}<footer>&copy; {i}</footer>{end}"


ARTICLES = [
    ("<h1>A &amp; B</h1><p>one\n two&nbsp;&lt;b&gt; <b>bo</b>ld<i>!</i></p>@<p>x<br>y</p>", "A & B\none two <b> bold!\nx y"),
    ("<h1>C<p><b>open<br><p>next &#233;&#x41;&eacute &am</p>@<ul><li>l1<li>l2 <a href='>'>l</a></ul>", "C\nopen\nnext éAé &am\nl1\nl2 l"),
    ("<p>only</p>@", "only"),
    ("<header><h1>Title</h1></header><p>p1</p><p>p1</p><table><tr><td>c1<td>c2<tr><td>c3</table>@<blockquote><p>q</p></blockquote><div>text in div<p>deep</p></div>",
     "Title\np1\np1\nc1\nc2\nc3\nq\ntext in div\ndeep"),
    ("@", ""),
    ("<p>" + "long " * 30_000 + "</p>", "long " * 29_999 + "long"),
]


def test_main_text(spark):
    rows, want = [], {}
    for i in range(60):
        article, text = ARTICLES[i % len(ARTICLES)]
        rows.append((i, f"http://{'hot' if i % 3 else 'h%d' % (i % 9)}.net/{i}", page(i, article), "c", "t"))
        want[i] = text
    rows += [(100, "http://hot.net/n", None, "c", "t"), (101, None, "", "c", "t"), (102, None, "just text", "c", "t"), (103, "http://hot.net/", "<", "c", "t"), (0, *rows[0][1:]),
             (104, "http://odd.net", "<p class='a>b", "c", "t"),
             (105, "http://deep.net", "<div>" * 5000 + "<p>deep</p>" + "</div>" * 4990 + "<p>more", "c", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string").select("page_id", "url", "html", "host", "text").repartition(4)
    out = X.main_text(df.drop("host", "text")).collect()
    assert sorted(r["page_id"] for r in out) == sorted(r[0] for r in rows)
    for r in out:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] < 100:
            assert r["text"] == want[r["page_id"]], r["page_id"]
    got = {r["page_id"]: r["text"] for r in out}
    assert (got[100], got[101], got[102]) == ("", "", "just text")
    assert got[105] == "deep\nmore"
    assert X.main_text(df.drop("host", "text").limit(0)).collect() == []


def test_without_article_the_largest_element_is_the_text(spark):
    rows = [(i, "http://a.net/%d" % i, f"<body>{NAV}<div id=top>Welcome to the site of sites</div><div class=body><p>{'word%d ' % i * 40}</p><p>end {i}</p></div><div>Copyright by us all</div></body>") for i in range(6)]
    out = X.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: ("word%d " % i * 40).strip() + f"\nend {i}" for i in range(6)}


def texts_of(spark, pages):
    rows = [(i, url, p) for i, (url, p) in enumerate(pages)]
    return [r["text"] for r in sorted(X.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


def test_two_templates_on_a_host(spark):
    """Each page by its own skeleton: neither an article nor a heavier element elsewhere on the host empties it."""
    a = [("http://two.net/a%d" % i, f"<body>{NAV}<article><p>{'long%d ' % i * 50}</p></article></body>") for i in range(4)]
    b = [("http://two.net/b%d" % i, f"<body>{NAV}<div class=content><p>other {i}</p></div></body>") for i in range(4)]
    c = [("http://div.net/a%d" % i, f"<body>{NAV}<div class=story><p>{'long%d ' % i * 50}</p></div></body>") for i in range(4)]
    d = [(u.replace("two", "div"), p) for u, p in b]
    long = [("long%d " % i * 50).strip() for i in range(4)]
    other = [f"other {i}" for i in range(4)]
    assert texts_of(spark, a + b) == long + other
    assert texts_of(spark, c + d) == long + other


def test_without_article_titles_and_short_blocks_stay(spark):
    word = lambda i, n: ("word%d " % i * n).strip()
    a = [("http://t.net/%d" % i, f"<body>{NAV}<div id=content><h1>Title {i}</h1><div class=body><p>{word(i, 400)}</p></div></div><div>Copyright by us all</div></body>") for i in range(4)]
    b = [("http://s.net/%d" % i, f"<body>{NAV}<section class=intro><p>In {i}</p></section><section class=text><h2>Part {i}</h2><div>{word(i, 400)}</div></section><div class=end>out {i}</div></body>")
         for i in range(4)]
    assert texts_of(spark, a) == [f"Title {i}\n{word(i, 400)}" for i in range(4)]
    assert texts_of(spark, b) == [f"In {i}\nPart {i}\n{word(i, 400)}\nout {i}" for i in range(4)]


def test_blocks_that_begin_alike_and_copies_are_no_template(spark):
    licence = "Permission is granted to " + "copy and share " * 20
    a = [("http://l.net/%d" % i, f"<body>{NAV}<div><p>{licence}page {i}</p></div><div>Copyright by us all</div></body>") for i in range(4)]
    b = [("http://c.net/%d" % i, f"<body>{NAV}<div><p>one story</p></div><div class=ad>buy {i}</div></body>") for i in range(4)]
    c = [("http://m.net/%d" % i, f"<body>{NAV}<div class=x><h1>Other</h1><p>said {i}</p></div></body>") for i in range(4)]
    d = [("http://m.net/c%d" % i, f"<body>{NAV}<div class=y><p>one story</p></div><div class=ad>buy {i}</div></body>") for i in range(4)]
    assert texts_of(spark, a) == [f"{licence}page {i}" for i in range(4)]
    assert texts_of(spark, b) == ["one story"] * 4
    assert texts_of(spark, c + d) == [f"said {i}" for i in range(4)] + ["one story"] * 4


@pytest.mark.parametrize("a,b,want", [
    ("<a>#</>", "<a>#</>", "<a>#</>"),
    ("<a>#</>", "<a></>", "<a>(#)?</>"),
    ("<u>(<li>#</>)+</>", "<u><li>#</></>", "<u>(<li>#</>)+</>"),
    ("<u></>", "<u>(<li>#</>)+</>", "<u>(<li>#</>)*</>"),
    ("<u>(<p>#</>)?</>", "<u><p>#</></>", "<u>(<p>#</>)?</>"),
    ("<a>#</><b>#</>", "<b>#</><c>#</>", "(<a>#</>)?<b>#</>(<c>#</>)?"),
    ("<u>(<p>#</>)+</>", "<u><p><q>#</></></>", "<u>(<p>(#)?(<q>#</>)?</>)+</>"),
])
def test_alignment(a, b, want):
    make = lambda e: X.parsed(e, [[1, 0, 1, 1]] * e.count("#"))
    got = X.expression(X.align(make(a), make(b)))
    assert got == want


def matches(expr: str, stream: str) -> bool:
    return re.fullmatch(re.sub(r"<[^>]*>|#", lambda m: re.escape(m[0]), expr.replace("(", "(?:")), stream) is not None


def written(nodes) -> str:
    return "".join("#" if n[0] == "#" else f"<{n[1]}>{written(n[2])}</>" for n in nodes)


def test_wrapper_matches_every_page():
    trees = [X.blocks_of(page(i, ARTICLES[i % 5][0])) for i in range(40)]
    whole = None
    for tree in trees:
        own, _ = X.skeleton(tree)
        assert matches(X.expression(own), written(tree))
        own = X.parsed(X.expression(own), [[1, 0, 1, 1]] * X.expression(own).count("#"))
        whole = own if whole is None else X.fold(X.align(whole, own))
    assert all(matches(X.expression(whole), written(t)) for t in trees)


def test_whole_table(spark):
    """The pages of the test table against a plain reading of their articles."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in X.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_a_name_that_only_hints_at_chrome_does_not_cost_an_article_its_text(spark):
    a = [("http://r.net/%d" % i, f'<body>{NAV}<main><div class="share-price-report"><p>Shares rose {i}</p></div></main></body>') for i in range(4)]
    b = [("http://i.net/%d" % i, f'<body>{NAV}<article><div class="banner-image-caption">Seen {i}</div><p>said {i}</p><div class="ad-slot">buy {i}</div></article></body>') for i in range(4)]
    # the same text on every page: here the wrapper takes the hint
    c = [("http://w.net/%d" % i, f'<body>{NAV}<article><p>said {i}</p><div class="subscribe-today">Get our paper</div></article></body>') for i in range(4)]
    d = [("http://w1.net/", '<body><article><p>said</p><div class="subscribe-today">Get our paper</div></article></body>')]
    assert texts_of(spark, a) == [f"Shares rose {i}" for i in range(4)]
    assert texts_of(spark, b) == [f"Seen {i}\nsaid {i}" for i in range(4)]
    assert texts_of(spark, c) == [f"said {i}" for i in range(4)]
    assert texts_of(spark, d) == ["said\nGet our paper"]


def irregular(i: int, n: int = 60) -> tuple[str, str]:
    """A page of n blocks of five kinds in an order of its own, and its text."""
    import random

    rng = random.Random(i)
    blocks = [(rng.choice(["p", "h2", "ul", "pre", "blockquote"]), f"w{i} {k}") for k in range(n)]
    inner = "".join(f"<ul><li>{t}</li></ul>" if tag == "ul" else f"<{tag}>{t}</{tag}>" for tag, t in blocks)
    return inner, "\n".join(t for _, t in blocks)


def test_wrapper_of_many_skeletons_stays_small(spark):
    """400 different skeletons of a host: the wrapper is generalised, and a tree of groups infers it."""
    import time

    made = [irregular(i) for i in range(400)]
    t0, whole = time.time(), None
    for inner, _ in made:
        own, _ = X.skeleton(X.blocks_of(f"<article>{inner}</article>"))
        own = X.parsed(X.expression(own), [[1, 0, 1, 1]] * X.expression(own).count("#"))
        whole = own if whole is None else X.fold(X.align(whole, own))
    assert time.time() - t0 < 20
    assert len(list(X.slots(whole))) <= X.LONGEST_LIST
    for inner, _ in made[::40]:
        assert matches(X.expression(whole), written(X.blocks_of(f"<article>{inner}</article>")))
    pages = [("http://many.net/%d" % i, f"<body>{NAV}<article>{inner}</article><div class=ad>buy</div></body>") for i, (inner, _) in enumerate(made)]
    assert texts_of(spark, pages) == [text for _, text in made]
