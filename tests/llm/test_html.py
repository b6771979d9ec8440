import html
import re
import tracemalloc

import pytest

from foliomill.llm.op08_html_text import main_text, op8_html_text, parsed, parts_of

SMALL = "/root/testdata/sf0.01"


def text_of(page):
    return "\n".join(t for f, t in parsed(page)[0] if not f.boilerplate)


def test_markup():
    assert text_of("<p>a &amp; b&nbsp;c <b>d</b>e<br>f<p>g") == "a & b c de f\ng"
    assert text_of("<ul><li>a<li>b</ul>c<!-- <p>x --><table><tr><td>1<td>2<tr><td>3</table>") == "a\nb\nc\n1\n2\n3"
    assert text_of("<script>if (a<b) '</p>'</script><style>p{}</style>x<SCRIPT>y") == "x"
    assert text_of('<p title="a > b">x</p><p hidden>y</p><div class="ad">z</div><div class="shadow">w</div>') == "x\nw"
    assert text_of("<p>a < b and 3 > 2 &lt;i&gt; &#233;&#x1F642; &am") == "a < b and 3 > 2 <i> é🙂 &am"
    assert text_of("x</b></div></p>y<a href='") == "x\ny"
    assert text_of("") == text_of("<html>") == text_of("<p> \n </p>") == ""
    assert text_of("<article><header><h1>T</h1></header><p>x</p><section class='comments'><p>no</p></section></article><header>H</header>") == "T\nx"


def test_template_of_a_host(spark):
    page = "<html><body><div><span>Our site</span><p>Welcome to us</p></div><div>{}</div><div><p>Write to us</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"<p>story {i}</p><p>more {i}</p>"), "x") for i in range(8)]
    rows += [(20, "http://other.example/", page.format("alone"), "x"), (21, None, None, None), (22, "no url", "", ""), (3, rows[3][1], rows[3][2], "y")]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, Text string"))
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    texts = {r.page_id: r.text for r in got.collect()}
    assert {i: texts[i] for i in range(8)} == {i: f"story {i}\nmore {i}" for i in range(8)}
    assert texts[20] == "Our site\nWelcome to us\nalone\nWrite to us" and texts[21] == texts[22] == ""
    assert got.count() == len(rows)
    assert main_text(got.drop("text").limit(0)).count() == 0


def test_query_against_the_article_element(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = op8_html_text(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"(?s)<article>(.*?)(</article>|\Z)", pages[r.page_id].html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?(b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        plain = "\n".join(b for b in blocks if b)
        assert "".join(r.text.split()) == "".join(plain.split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        assert r.text.count("\n") == plain.count("\n")


def test_wrappers_and_an_open_head_cost_no_article(spark):
    words = ["page with-sidebar", "has-sidebar", "overflow-hidden", "comments-open", "no-ads", "hidden-xs", "sidebar", "comments"]
    pages = [f"<body><div class='{w}'><article><p>story</p></article></div><div>x</div></body>" for w in words]
    pages += [f"<body><div class='{w}'><p>story</p></div></body>" for w in words]
    pages += ["<head><title>T</title><meta charset=utf-8><body><article><p>story</p></article>", "<head><title>T</title><p>story</p>", "<head>story"]
    pages += ["<form><div><article><p>story</p></article></div></form>", "<form><p>story</p></form>"]
    assert text_of("<div class='is-hidden'>x</div><div class='site-footer'>y</div><div class='cookie-notice'>z</div>") == ""
    no = ["<nav><article>x</article></nav>", "<div hidden><article>x</article></div>", "<footer>x</footer>", "<head><title>T</title></head>"]
    no += ["<div class='comments'><article class='comment'>x</article></div><main><p>y</p></main>"]
    rows = [(i, f"http://h{i}.example/", p) for i, p in enumerate([*pages, *no])]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == ["story"] * len(pages)
    assert [got[i] for i in range(len(pages), len(rows))] == ["", "", "", "", "y"]
    related = "<div><p>the whole story</p></div><div class='related-posts'><article>teaser</article></div><div class='cookie-notice'>c</div>"
    assert main_text(spark.createDataFrame([(1, "", related)], "page_id long, url string, html string")).first().text == "the whole story"


def test_copies_on_a_host_have_one_vote(spark):
    page = "<html><body><div><span>Our site</span><p>Welcome to us</p></div><div>{}</div><div><p>Write to us</p></div></body></html>"
    same = "".join(f"<p>copied {i}</p>" for i in range(5))
    pages = [page.format(same)] * 12 + [page.format(f"<p>story {i}</p>") for i in range(6)] + [page.format("<p>twice</p>")] * 2
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    rows += rows[:3] * 2 + rows[13:14] * 3
    # Copies whose heads differ have one content all the same.
    rows = [(i, u, p.replace("<body>", f"<head><title>{u}</title></head><body>")) for i, u, p in rows]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = [(r.page_id, r.text) for r in main_text(docs).collect()]
    want = ["\n".join(f"copied {i}" for i in range(5))] * 12 + [f"story {i}" for i in range(6)] + ["twice"] * 2
    assert sorted(got) == sorted((i, want[i]) for i, _, _ in rows)


def test_boilerplate_inside_articles(spark):
    page = "<html><body><nav>menu</nav><article><p>Posted by the desk</p>{}<div>Read our offers</div></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"<h1>title {i}</h1><p>the long story of number {i} is told in this place</p>")) for i in range(9)]
    # Near copies of one article are no template.
    near = "".join(f"<p>paragraph {i} of what very many pages of the host have in common</p>" for i in range(5))
    rows += [(i, f"http://near.example/{i}", f"<html><body><article>{near}<p>and {i}</p></article></body></html>") for i in range(20, 28)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"title {i}\nthe long story of number {i} is told in this place" for i in range(9))
    assert all(got[i].count("paragraph") == 5 and got[i].endswith(f"and {i}") for i in range(20, 28))


def chosen(page):
    return "\n".join(t for _, t in parts_of(parsed(page)[0])[0])


@pytest.mark.parametrize(
    "page, want",
    [
        ("<h1 class='entry-title'>T</h1><div><p>The whole long article is here</p></div>", "T\nThe whole long article is here"),
        ("<ul class='post-list'><li>one</li></ul><div><p>The whole long article is here</p></div>", "one\nThe whole long article is here"),
        ("<body class='single-post'><header>Site name</header><article><p>story</p></article></body>", "story"),
        ("<body><article><p>story</p></article><div class='post-meta'>meta</div></body>", "story"),
        ("<article><p>a</p><div class='social-science'>b</div><div class='search-results-analysis'>c</div></article>", "a\nb\nc"),
        ("<article><p>a</p><div class='notice-board'>b</div><section id='comments-on-law'>c</section></article>", "a\nb\nc"),
        ("<article><p>a</p><div class='social-share'>b</div><section id='comments'>c</section><p class='adUnit'>d</p></article>", "a"),
        ("<div class='site-header'>S</div><div id='content'><h1>T</h1><p>long story of the day</p></div><div>x</div>", "T\nlong story of the day"),
        ("<div class='site_title'>S</div><div class='entry-header'><h1>T</h1></div><p>long story of the day</p>", "T\nlong story of the day"),
    ],
)
def test_names_of_parts(page, want):
    assert chosen(page) == want


@pytest.mark.parametrize("tag", ["div", "b", "li", "p", "table"])
def test_many_open_tags_cost_their_length(tag):
    tracemalloc.start()
    blocks, paths = parsed(f"<{tag}>" * 50_000 + "x")
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [t for _, t in blocks] == ["x"] and len(paths) == 50_000 and most < 50e6


def test_stray_ends_behind_many_open_blocks():
    blocks, _ = parsed("<i>" + "<div>" * 20_000 + "</i>" * 20_000 + "x</div>y")
    assert [t for _, t in blocks] == ["x", "y"]
