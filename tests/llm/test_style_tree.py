"""Main text of pages: the parser's cases, the tree with and without names, entropy by the plain rule."""

import math
from collections import Counter, defaultdict

from tidemark.llm import html_main

SCHEMA = "page_id long, url string, html string"


def test_main_text():
    page = (
        "<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='cookie-notice'>ok?</div><article><h1>A &amp; B</h1><p>one\n two<br>three<p>fo<b>ur</b>"
        "<div class=comments><p>nice!</div><script>x</script></article><footer>end</footer></body>"
    )
    assert html_main.main_text(page, set()) == "A & B one two three four"
    assert html_main.main_text("", set()) == "" and html_main.main_text("plain &lt; text", set()) == "plain < text"


def test_names_of_wrappers_and_unclosed_elements_lose_nothing():
    text = lambda page: html_main.main_text(page, set())
    assert text("<form><div><article><p>a</p></article></div></form>") == "a"
    assert text("<div class='social-science'>x</div>") == "x" and text("<div class='site-footer'>x</div><p>y") == "y"
    assert text("before<audio><p>after text") == "before after text" and text("a<select><p>b") == "a b"
    assert text("<body class='layout with-sidebar'><div class='sidebar-wrapper'><article>ok<ul class=comment-list><li>no</ul></article></div>") == "ok"
    assert text("<article>ok</article><div id=comments><article>c</article></div><aside><article>d</article></aside>") == "ok"


def _pages(n, extra=""):
    return [(i, "http://h/x", f"<body><div class=x1>Same words each time</div><div class=x2><p>Text {i} own</p>{'<p>more of %d</p>' % i if i % 3 else ''}{extra}</div></body>") for i in range(n)]


def test_style_tree_drops_what_a_host_repeats(spark):
    got = html_main.extract(spark.createDataFrame(_pages(30), SCHEMA)).toPandas()
    assert not got.text.str.contains("Same words").any() and got.text.str.startswith("Text").all() and (got.n_low == 1).all()
    odd = [(1, None, None), (2, "", "<p>x"), (2, "", "<p>x"), (3, "http://k", "<p>" + "long " * 300_000)]
    clash = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "1 AS host", "2 AS path", "3 AS removed", "4 AS text")
    assert sorted(map(len, html_main.extract(clash).toPandas().text)) == [0, 1, 1, 1_499_999]
    assert html_main.extract(clash.limit(0)).count() == 0


def test_the_tree_decides_inside_articles_and_without_names(spark):
    rows = [(i, "http://h/x", f"<nav><a>Home</a></nav><article><h1>Title {i}</h1><p>Text {i} own</p><div class=zz>Please read our other pages</div></article><footer>all rights</footer>") for i in range(20)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert {r.text for r in html_main.extract(pages).collect()} == {f"Title {i} Text {i} own" for i in range(20)}
    assert {r.text for r in html_main.extract(pages, by_name=False).collect()} == {f"Title {i} Text {i} own" for i in range(20)}
    # a host of two pages says too little to touch an article, and copies of a page say nothing
    assert {r.text for r in html_main.extract(pages.where("page_id < 2")).collect()} == {f"Title {i} Text {i} own Please read our other pages" for i in range(2)}
    copies = spark.createDataFrame([(i, f"http://h/{i}", "<article><p>one text that is copied</p></article>") for i in range(20)], SCHEMA)
    assert {r.text for r in html_main.extract(copies).collect()} == {"one text that is copied"}


def test_importance_by_the_plain_rule(spark):
    pages = spark.createDataFrame(_pages(12, "<ul class=b><li>one</li><li>two</li></ul>"), SCHEMA)
    got = {r.path: r.importance for r in html_main.node_importance(pages).collect()}
    contents, counts = defaultdict(Counter), defaultdict(Counter)
    for _, _, page in _pages(12, "<ul class=b><li>one</li><li>two</li></ul>"):
        seen = {(p, t) for p, t, _, _ in html_main.blocks(page)}
        for p, t in seen:
            contents[p][t] += 1
        for p, k in Counter(p for p, _ in seen).items():
            counts[p][k] += 1
    own = {}
    for p, by in contents.items():
        m = sum(counts[p].values())
        own[p] = 1 - sum(k * math.log(k) for k in by.values()) / sum(by.values()) / math.log(m)
    for p in contents:
        m, styles = sum(counts[p].values()), len(counts[p])
        layout = -sum(k / m * math.log(k / m) for k in counts[p].values()) / math.log(m)
        family = [q for q in contents if q.rsplit("/", 1)[0] == p.rsplit("/", 1)[0]]
        branch = sum(own[q] * sum(contents[q].values()) for q in family) / sum(sum(contents[q].values()) for q in family)
        few, early = html_main.DAMPING**styles, html_main.DAMPING ** (m - 1)
        tree = (1 - few) * ((1 - html_main.LAYOUT) * own[p] + html_main.LAYOUT * layout) + few * (own[p] + branch) / 2
        assert math.isclose(got[p], (1 - early) * tree + early * html_main.ELSEWHERE, abs_tol=1e-9)


def test_titles_frames_and_teasers():
    text = lambda page: html_main.main_text(page, set())
    assert text('<article><div class="article-header"><h1>Title</h1><p>Lead</p></div><p>Body of it</p><div class="comments">no</div></article>') == "Title Lead Body of it"
    assert text('<div class="page-header">Site</div><div class="left-side"><p>Menu</p></div><article><p>Body</p></article>') == "Body"
    assert text('<nav>menu</nav><div class="left-side"><p>Body text</p></div>') == "Body text"
    assert text('<form><nav>menu</nav><p>Body</p><div class="ads">buy</div><div class="comments">no</div></form>') == "Body"
    assert text('<form><div class="ads">buy</div></form><nav>menu</nav>') == ""
    assert text('<div><p>A long text that is what the page is about and more of it</p></div><article>Teaser</article>').startswith("A long text")
    assert text('<p>Short</p><article>A longer article that holds most of the page</article>') == "A longer article that holds most of the page"
