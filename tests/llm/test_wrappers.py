"""Main text: templates, slots, broken markup, odd pages."""

import re

import pytest

from ledgerwatch.llm import wrappers
from ledgerwatch.llm.common import table

SCHEMA = "page_id long, url string, html string, host int, text string, template string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", "t") for r in rows], SCHEMA)


def texts(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract(pages(spark, rows)).collect()}


PAGE = (
    "<html><head><title>t{0}</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>m{0}</a></nav>"
    "<div class='cookie-notice'>We use cookies {0}</div><div id=content><h1>Head {0}</h1><p>One <b>b{0}</b>, two</p><p>Share this page</p>"
    "<p>Three{0}<br>four</p></div><aside>see {0}</aside><section class=\"comments\"><p>reader {0}</p></section>"
    "<form><input value=a>Search</form><footer>&copy; {0}</footer><script>var x='<p>no</p>'</script></body></html>"
)


def test_constant_nodes_are_template(spark):
    rows = [(i, "http://h.org/%d" % i, PAGE.format(i)) for i in range(10)]
    got = texts(spark, rows)
    for i in range(10):
        assert got[i] == f"Head {i} One b{i}, two Three{i} four"


def test_single_page_has_no_template(spark):
    assert texts(spark, [(1, "http://h.org/", PAGE.format(1))]) == {1: "Head 1 One b1, two Share this page Three1 four"}


def test_articles_of_the_given_pages(spark):
    given = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in wrappers.extract(given).collect()}
    import html

    for r in given.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inside)).split())


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a b"), ("a<br/>b", "a b"), ("x<b>y</b>z", "xyz"),
        ("&lt;p&gt; &amp;amp; &eacute; &#x41;", "<p> &amp; é A"), ("<p>a</b></p>b</div>c", "a bc"), ("<!-- <p>no</p> -->y", "y"), ("<!-- open", ""),
        ("<script>if (a<b) '</p>'", ""), ("<article>in</article>out", "in"), ("<ul><li>a<li>b</ul>", "a b"), ("1 < 2 <", "1 < 2 <"),
        ("<article><header>t</header>x<footer>f</footer></article>", "t x"), ("<p title='>'>q</p>", "q"), ("<A CLASS=NAV>n</A>k", "k"),
        ("<article><div class='post-header'>h</div>x</article><div class=header>y</div>", "h x"), ("<div class=header>y</div>z", "z"),
        ("<article>a<section id=comments>c</section><div class='share-bar'>s</div>b</article>", "a b"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("a\u00a0\n b", "a b"), ("<div class=addition>kept</div>", "kept"),
    ],
)
def test_markup(source, text):
    assert wrappers.Extractor(wrappers.induce([])).text(source) == text


def test_matching_is_the_largest_one():
    """Against a plain recursion over all ordered matchings."""
    from random import Random

    rng = Random(5)

    def made(depth):
        inner = "".join(made(depth - 1) for _ in range(rng.randrange(3))) if depth else ""
        tag = rng.choice(["div", "section"])
        return f"<{tag}>{inner}</{tag}>"

    def slot_of(node):
        return wrappers.Slot(node.label, children=[slot_of(run[0]) for run in node.runs])

    def plain(slot, node):
        if slot.label != node.label:
            return 0

        def rest(i, j):
            if i == len(slot.children) or j == len(node.runs):
                return 0
            return max(rest(i + 1, j), rest(i, j + 1), max(plain(slot.children[i], x) for x in node.runs[j]) + rest(i + 1, j + 1))

        return 1 + rest(0, 0)

    for _ in range(60):
        a, b = wrappers.parse(made(3)), wrappers.parse(made(3))
        assert wrappers.Aligner().size(slot_of(a), b) == plain(slot_of(a), b)


def test_deep_and_long_pages(spark):
    deep = "<div>" * 400 + "x" + "</div>" * 400
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    got = texts(spark, [(1, "http://a/1", deep), (2, "http://a/2", long), (3, "http://a/3", "y" * 200_000)])
    assert got[1] == "x" and len(got[2]) == 20_000 * 12 - 1 and got[3] == "y" * 200_000


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, None, None), (1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "http://h/", None), (3, "http://h/", "")]
    got = sorted(((r.page_id, r.url, r.text) for r in wrappers.extract(pages(spark, rows)).collect()), key=str)
    want = [(None, None, ""), (1, None, "a"), (1, None, "a"), (2, "http://h/", ""), (3, "http://h/", "")]
    assert got == sorted(want, key=str)
    assert wrappers.extract(pages(spark, [])).count() == 0


def test_copies_are_one_page(spark):
    rows = [(i, "http://h/%d" % i, "<p>same text</p>") for i in range(30)]
    assert set(texts(spark, rows).values()) == {"same text"}


def test_all_pages_of_a_host_are_counted(spark):
    """A line on 12 of 40 pages is no template, whichever pages they are; one on 36 is, and a loop over all pages agrees."""
    html = "<div><h1>Head {0}</h1>{1}<p>text {0}</p>{2}</div>"
    sources = [html.format(i, "<p>seldom</p>" if i % 10 < 3 else "", "<h2>often</h2>" if i % 10 else "") for i in range(40)]
    for order in (1, -1):
        got = texts(spark, [(i, "http://h.org/%d" % i, x) for i, x in list(enumerate(sources))[::order]])
        loop = wrappers.Extractor(wrappers.induce(sources))
        for i, source in enumerate(sources):
            assert got[i] == f"Head {i}" + (" seldom" if i % 10 < 3 else "") + f" text {i}" == loop.text(source)


def test_texts_are_counted_beyond_a_few_pages(spark, monkeypatch):
    """The counts are those of all different pages, in groups or not."""
    monkeypatch.setattr(wrappers, "FAN", 3)
    shapes = ["<p>t{0}</p>", "<p>t{0}</p><ul><li>x{0}</ul>", "<h2>a{0}</h2><p>t{0}</p>", "<p>t{0}</p><blockquote>q{0}</blockquote>", "<table><tr><td>{0}</table>"]
    sources = [shapes[i % 5].format(i) + ("<h3>same</h3>" if i < 39 else "<h3>other</h3>") for i in range(50)]
    rows = spark.createDataFrame([("h", x) for x in sources * 2], "host string, html string")
    found = wrappers.json.loads(wrappers.templates(rows).first().template)
    known = wrappers.Extractor(wrappers.json.dumps(found | {"sure": []}))
    said = wrappers.Counter(x for page in sources for x in known.said(page))
    assert max(said.values()) == 39 and found["sure"] == []
    more = rows.unionByName(rows.sparkSession.createDataFrame([("h", "<p>n%d</p><h3>same</h3>" % i) for i in range(6)], rows.schema))
    assert len(wrappers.json.loads(wrappers.templates(more).first().template)["sure"]) == 1
