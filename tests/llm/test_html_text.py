import html
import re
from html.parser import HTMLParser

from platewright.llm import html_text as h

LONG = "This is a fairly long paragraph of the article, with enough letters to surge over the threshold. "


class Plain(HTMLParser):
    """Brute force for pages with one article: the text of its blocks by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in h.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag not in h.INLINE:
            self.blocks.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_equals_the_standard_parser_on_pages_with_an_article(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r for r in h.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        plain = Plain()
        plain.feed(r["html"])
        want = "\n".join(x for x in (" ".join(b.split()) for b in plain.blocks) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def page(body):
    return f"<html><head><title>t</title><style>x{{}}</style></head><body>{body}</body></html>"


def test_without_an_article_element():
    body = (
        "<header><h1>Site</h1></header><div id='main-menu'><ul><li><a href=/a>Home</a><li><a href=/b>News and more things to see here</a></ul></div>"
        "<div class=cookie-notice>We use cookies " + LONG + "</div>"
        "<div class='page'><h2>Head&shy;line &amp; more</h2><p>" + LONG * 2 + "<p>Short.<p>" + LONG + "<br>next <i>line</i><p>The end.</div>"
        "<div class='sidebar'><p>" + LONG * 3 + "</div><form><p>" + LONG * 5 + "</p></form>"
        "<div class=comments><p>" + LONG * 9 + "</p></div><footer>&copy; us</footer>"
    )
    assert h.main_lines(page(body)) == ["Head\xadline & more", (LONG * 2).strip(), "Short.", LONG + "next line", "The end."]


def test_inside_an_article():
    body = (
        "<div class=ad>" + LONG * 9 + "</div><article class='post sidebar-left'><header><h1>Title</h1></header><p>One<!-- x -->two  &nbsp; three</p>"
        "<aside>" + LONG + "</aside><ul><li>a<li>b</ul><p>x &lt;b&gt;<script>if (a<b) '</p>'</script> y</p><section class='comments'><article class=comment>"
        + LONG * 4 + "</article></section><footer>tags</footer></article><article class=teaser><p>More</p></article>"
    )
    assert h.main_lines(page(body)) == ["Title", "Onetwo three", "a", "b", "x <b> y"]


def test_names_that_tell_of_other_elements():
    body = "<div class='layout has-sidebar'><div id=content><h1>Head</h1><p>" + LONG + "</p></div><div class=sidebar>" + LONG + "</div></div>"
    assert h.main_lines(page(body)) == ["Head", LONG.strip()]
    assert h.main_lines(page("<div class=banner-page><p>" + LONG + "</p></div><footer>x</footer>")) == [LONG.strip()]


def test_hidden_elements():
    body = "<article><p class='overflow-hidden' aria-hidden=false>One</p><p hidden>Two</p><p style='display: none'>Three</p><div title='hidden'>Four</div></article>"
    assert h.main_lines(page(body)) == ["One", "Four"]


def test_broken_and_empty(spark):
    assert h.main_lines("") == [] and h.main_lines("<p") == [] and h.main_lines("just text") == ["just text"]
    assert h.main_lines("<article><p>a<b>c</p></div></i>d<p>e &am <a href='x") == ["ac", "d", "e &am"]
    assert h.main_lines('<article><p title="a > b" x=\'<\'>t</p><p a="unclosed>u</p></article>')[0] == "t"
    rows = spark.createDataFrame([(1, None, None, 3), (2, "u", "", 3), (None, "u", "<article>x</article>", 3), (None, "u", "<article>x</article>", 3)], "page_id long, url string, html string, n_chars int")
    got = h.extract(rows).collect()
    assert sorted(r["text"] for r in got) == ["", "", "x", "x"]
    assert h.extract(rows.limit(0)).count() == 0


def test_linear_on_a_long_page():
    assert len(h.main_lines("<article>" + "<p>a</p><" * 60000 + "\"'" * 1000)) >= 60000
    assert re.sub(r"\s", "", html.unescape("&amp;")) == "&"


def test_text_in_two_marked_elements():
    two = "<article><h1>One</h1><p>" + LONG + "</p></article><p>" + LONG * 3 + "</p><article><p>" + LONG * 2 + "</p></article>"
    assert h.main_lines(page(two)) == ["One", LONG.strip(), (LONG * 2).strip()]
    assert h.main_lines(page("<main><p>Lede.</p><article><p>" + LONG + "</p></article></main>")) == ["Lede.", LONG.strip()]


def test_interruptions_without_an_article_element():
    box = "<ul>" + "<li class=share>Share this with all of your friends" * 6 + "</ul>"
    cells = "<table>" + "<tr><td>a</td><td>b</td></tr>" * 3 + "</table>"
    more = "<ul>" + "<li>point" * 6 + "</ul>"
    want = ["Head", LONG.strip(), *["a", "b"] * 3, *["point"] * 6, (LONG * 2).strip(), "The end."]
    body = "<h1>Head</h1><p>" + LONG + "</p>" + box + cells + more + "<p>" + LONG * 2 + "</p><p>The end.</p>"
    assert h.main_lines(page(body)) == want and h.main_lines(page("<div class=page>" + body + "</div>")) == want
    parts = "<div><div><h1>Head</h1><p>" + LONG + "</p></div>" + cells + more + "<div><p>" + LONG * 2 + "</p><p>The end.</p></div></div>"
    assert h.main_lines(page(parts)) == want


def test_long_attribute_values():
    for quote in "\"'":
        long = f"data-x={quote}{'a > b < c ' * 1000}{quote}"
        body = f"<nav {long}><p>{LONG * 3}</p></nav><div><article {long}><div {long}>One</div><p>Two</p></article></div><p>{LONG}</p>"
        assert h.main_lines(page(body)) == ["One", "Two"]
    for start in ('<a x="', "<a x='", '<a "\'', '<a "" x="'):
        assert len(h.main_lines("<article><p>a</p>" + start * 60000)) <= 2
