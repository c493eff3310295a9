"""Extraction on planted pages and layouts."""

import random
import re
import time
import tracemalloc
from collections import Counter

import pytest

from tilescape.llm import html_text as H
from tilescape.llm.queries import op8_html_text


def text(source, winners=()):
    return H.parse(source).text(list(winners))


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<article><p>One  two\n three</p><p>four</p></article>", "One two three\n\nfour"),
        ("<body><nav><a href=x>menu</a></nav><div id=main><h1>T</h1><p>body text is here</p></div><footer>f</footer></body>", "T\n\nbody text is here"),
        ("<article><h1>A &amp; B</h1><p><b>x<br>y<p>z &lt;&#39;&eacute;", "A & B\n\nx y\n\nz <'é"),
        ("<div class='ad'>buy buy buy buy buy buy</div><article>t</article>", "t"),
        ("<article><p>a</p><div class=comments><p>no</p></div><aside>no</aside><form>no</form><p>b</p></article>", "a\n\nb"),
        ("<main><article><header><h1>H</h1><p>by line</p></header><p>p</p></article></main>", "H\n\np"),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <p>c</p> --><article><p>x</p></article>", "x"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\n\nb\n\n1\n\n2"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("plain text", "plain text"),
        ("", ""),
        (None, ""),
        ("<nav>only menu</nav>", ""),
        ("<article><p>&nbsp; </p></article>", ""),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<script>never closed <p>x", ""),
        ("<div class='cookie-notice'><p>We use cookies and more and more</p></div><div class=post><p>Hi there</p></div>", "Hi there"),
    ],
)
def test_pages(source, expected):
    assert text(source) == expected


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<div class=content><p>intro</p><section><p>A</p></section><section><p>B</p></section></div>", "intro\n\nA\n\nB"),
        ("<div class=content><p>intro</p><section><p>" + "A long. " * 99 + "B</p></section></div>", "intro\n\n" + "A long. " * 99 + "B"),
        ("<body><div class=intro><p>what it is about</p></div><div class=body><p>and the rest of it, which is longer</p></div></body>", "what it is about\n\nand the rest of it, which is longer"),
        ("<div><p>before</p><table><tr><td>one<td>two</table><p>after</p></div>", "before\n\none\n\ntwo\n\nafter"),
        ("<main><h1>T</h1><p>lead</p><article><p>the story itself</p></article></main>", "T\n\nlead\n\nthe story itself"),
        ("<div class='w-1/2'><p>left</p></div><div class=w-1><p>right</p></div>", "left\n\nright"),
    ],
)
def test_nothing_of_the_main_text_is_left_behind(source, expected):
    assert text(source) == expected


def test_winners_are_chosen_by_the_text_they_hold():
    page = "<body><main><h1>T</h1><article><p>the story itself</p></article></main><div class=w-1><p>z</p></div></body>"
    assert text(page, ["/body/main"]) == "T\n\nthe story itself"
    assert text(page, ["/body/div.w-#", "/body/main"]) == "T\n\nthe story itself"
    assert text(page, ["/body/div.w-#"]) == "z"
    assert text("<div class=a><a href=x>more</a></div><div class=b><p>the text</p></div>", ["/div.a"]) == "the text"


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<div class='content-sidebar-wrap'><main><article><p>a</p></article></main></div>", "a"),
        ("<div class='layout has-sidebar'><p>a</p><div class=sidebar>no</div></div>", "a"),
        ("<div class=sidebar><main><p>a</p><div class=sidebar><p>no</p></div></main></div><div class=sidebar><p>no</p></div>", "a"),
        ("<article class='post category-search'><p>a</p></article><article class=related><p>no</p></article>", "a"),
        ("<article class=related><p>a</p></article>", "a"),
        ("<div class=elementor-widget><p>a</p></div><div class=elementor-widget><p>b</p></div>", "a\n\nb"),
        ("<article><h2 id=search>Search</h2><p>a</p><section id='search'><p>b</p></section><section id='related'><p>c</p></section></article>", "Search\n\na\n\nb\n\nc"),
        ("<article><p>a</p><section class=share-price><p>b</p></section><div class=share-buttons>no</div></article>", "a\n\nb"),
        ("<article><p>short</p><div class=comments><p>" + "no " * 99 + "</p></div></article><div class=related-posts>no</div>", "short"),
    ],
)
def test_marks_do_not_override_the_main_text(source, expected):
    assert text(source) == expected


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<div class='content no-sidebar'><h1>T</h1><p>the story</p></div>", "T\n\nthe story"),
        ("<div class='content with-sidebar has-related-news'><h1>T</h1><p>the story</p></div>", "T\n\nthe story"),
        ("<article class=no-sidebar><p>a</p></article>", "a"),
        ("<body><div class=a><p>first half of the story</p></div><div class=b><p>second half of the story</p></div></body>", "first half of the story\n\nsecond half of the story"),
        ("<article><p>a<svg><path d=x></p><p>b</p></article>", "a\n\nb"),
        ("<article><iframe src=x><p>a</p><video><p>b</p></article>", "a\n\nb"),
        ("<article><p>a</p><object data=x>fallback<p>b</p></article>", "a\n\nb"),
        ("<noscript><article><p>a</p></article>", "a"),
        ("<article><svg><title>no</title></svg><p>a</p></article>", "a"),
    ],
)
def test_layout_words_siblings_and_unclosed_elements(source, expected):
    assert text(source) == expected


def test_classes_are_generalised():
    assert H.generalised("div", {"class": "post-17 Wide"}) == "div.post-#.wide"


def test_hosts_vote(spark):
    side = "<div class=side><p>{}</p></div>"
    page = "<body><div class=content-{}><p>{}</p></div>" + side + "</body>"
    rows = [(i, "http://h.com/a", page.format(i, "main words of the page " * 3, "x")) for i in range(6)]
    rows += [(10, "http://h.com/b", page.format(10, "short", "a much longer text than the main one, but on the side"))]
    rows += [(11, None, "<p>no url</p>"), (12, "http://other.com", None), (13, "http://h.com/c", ""), (13, "http://h.com/c", ""), (14, "http://h.com/d", "<section><p>another layout</p></section>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as host", "'clash' as winners", "'clash' as text", "1 as n_chars")
    got = H.extract(spark, df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[10] == "short" and by[11] == "no url" and by[12] == by[13] == "" and by[14] == "another layout"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract(spark, df.where("false")).count() == 0


def test_consensus_against_a_plain_count(spark):
    """Votes of every page's own path, counted in Python; every page read again with its host's winners."""
    rng = random.Random(3)
    layouts = ["<body><div class=x{n}><p>{t}</p></div><div class=y><p>{s}</p></div></body>", "<body><main><p>{t}</p><section><p>{s}</p></section></main></body>", "<table><tr><td>{s}<td class=z>{t}</table>", "<body><section class='a b'><div><p>{t}</p></div><div><p>{s}</p></div></section></body>"]
    rows = []
    for i in range(120):
        host = rng.choice("abc")
        body = rng.choice(layouts[: 2 + "abc".index(host)]).format(n=i, t="long text " * rng.randint(0, 9), s="side " * rng.randint(0, 12))
        rows.append((i, f"https://{host}.org/{i}", body))
    votes, winners = {}, {}
    for _, url, body in rows:
        if best := H.parse(body).best():
            votes.setdefault(url[8], Counter())[best[0]] += 1
    for host, counted in votes.items():
        ranked = sorted(counted.items(), key=lambda x: (-x[1], x[0]))
        winners[host] = [p for i, (p, n) in enumerate(ranked) if i == 0 or n >= H.WINNING_SHARE * sum(counted.values())]
    got = {r["page_id"]: r["text"] for r in H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert got == {i: text(body, winners[url[8]]) for i, url, body in rows}


def test_joined_by_host_gives_the_same(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    first = sorted(H.extract(spark, pages).collect())
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    assert sorted(H.extract(spark, pages).collect()) == first


def test_whole_table(spark):
    """The generated pages have one template; its article is read with a plain pattern."""
    import html as codec

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in op8_html_text(spark, "/root/testdata/sf0.01").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(codec.unescape(re.sub(r"<[^>]+>", " " if False else "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_very_deep_and_long():
    deep = "<div>" * 3000 + "<p>x</p>"
    assert text(deep) == "x"
    assert len(text("<article>" + "<p>word</p>" * 50_000)) == 50_000 * 6 - 2
    text("<" * 200_000)
    text("<a " + "x='" * 50_000)
    text("<svg>" * 50_000 + "<p>x</p>" * 1000)


def test_time_and_memory_grow_with_the_length_alone():
    def took(n):
        source = "".join(f"<div class='level{'x' * (i % 7)} wide-{i}'>t{i % 10}</span>" for i in range(n))
        began = time.process_time()
        found = H.parse(source).text(["/div.level.wide-#"])
        assert found.startswith("t0\n\nt1\n\nt2") and found.count("t") == n
        return time.process_time() - began

    took(2_000)
    assert took(80_000) < 10 * took(20_000)
    source = "".join(f"<div class=wide-{i}>t" for i in range(100_000))
    tracemalloc.start()
    H.parse(source)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
