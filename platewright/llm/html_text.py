"""Main text of a page by line-block distribution.

Markup is stripped into lines, one per block element, each with its text length. Lines of menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments count as length
zero: they are told by element, role, class and id. If the page marks its article (article, main,
role=main, itemprop=articleBody), the lines outside all marked elements count as zero too. The lengths of the
other lines are summed over sliding windows of three lines; text surges where a sum rises over the threshold and dives
where it falls back to it. Of a page with marks every stretch between a surge and its dive is kept, else the one with the
most text and those in the same outermost block below body, and from the first to the last line that shares their marked or parent
elements every line with a length is kept: nothing is shortened or dropped.

In a line, character references are decoded, white space becomes one space, and ends are trimmed; lines
are joined by one newline. br counts as white space.

Each page is parsed by itself, in linear time, in Arrow batches; nothing shuffles.

Edge cases: a null or empty html gives the empty text, as does a page with no article text. Broken
markup (unclosed or stray tags, a cut end) is read as far as it goes. Repeated rows are kept. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.llm.common import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|textarea|select|title|object|video|audio|canvas)\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^<>\"']+|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+)>"
    r"|</?[a-zA-Z!?][^<>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
QUOTED, HIDDEN, NO_DISPLAY = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"(?i)(?:^|\s)hidden(?=\s|=|$)"), re.compile(r"(?i)display\s*:\s*none")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open element of the same kind.
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold lines rather than being one.
HOLDERS = frozenset("html body div section article main td table tbody tr blockquote figure ul ol dl center details".split())
ASIDE = frozenset("nav footer aside form button menu dialog head input fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted banner banners"
    " sidebar sidebars aside rail widget widgets nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager toc"
    " footer foot colophon copyright masthead topbar toolbar"
    " cookie cookies consent gdpr notice notices alert popup modal overlay paywall disclaimer"
    " comment comments commentlist discussion disqus replies reply respond feedback"
    " related recommended recommendations teaser teasers share sharing social newsletter subscribe subscription signup login search".split()
)
ARTICLE_WORDS = frozenset("article articlebody entry post story".split())


def _words(value: str) -> set[str]:
    """The words of class and id names; names like has-sidebar tell of another element and have none."""
    out: set[str] = set()
    for name in value.split():
        words = {w.lower() for part in re.split(r"[^A-Za-z]+", name) for w in [part, *re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", part)] if w}
        if not words & {"has", "with", "no", "without"}:
            out |= words
    return out


class _Page:
    """Lines of a page: text, whether it is set aside, letters within links, parent element, article number, outermost block."""

    def __init__(self, page: str, by_name: bool = True):
        self.by_name = by_name
        self.lines: list[tuple[str, bool, int, int, int, int]] = []
        #: tag, own number, set aside, number of the article around it (0: none), in a link, outermost block below body (0: none)
        self.open: list[tuple[str, int, bool, int, bool, int]] = [("", 0, False, 0, False, 0)]
        self.buffer: list[str] = []
        self.linked = 0
        self.marked: dict[int, int] = {}  # article number -> how surely it is one
        self.count, at = 0, 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            if m["tag"]:
                self._tag(m["tag"].lower(), bool(m["end"]), m["attrs"])
        self._text(page[at:])
        self._flush()

    def _text(self, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self.buffer.append(text)
        if self.open[-1][4]:
            self.linked += len(text.strip())

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            holder = next((x[1] for x in reversed(self.open) if x[0] in HOLDERS), 0)
            _, _, aside, article, _, top = self.open[-1]
            self.lines.append((text, aside, self.linked, holder, article, top))
        self.buffer, self.linked = [], 0

    def _tag(self, tag: str, ends: bool, attrs: str) -> None:
        if tag == "br":
            self.buffer.append(" ")
            return
        if tag not in INLINE:
            self._flush()
        if ends:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break
                if tag in INLINE and self.open[k][0] not in INLINE:
                    break
            return
        if tag in VOID or attrs.endswith("/") and tag in ("input", "link"):
            return
        if tag not in INLINE:
            while len(self.open) > 1 and (self.open[-1][0] in INLINE or self.open[-1][0] == "p"):
                self.open.pop()  # a block ends the open paragraph and what is open in it
        stops = SELF_ENDING.get(tag, ())
        if self.open[-1][0] in stops:
            self.open.pop()
        self.count += 1
        _, _, aside, article, link, top = self.open[-1]
        aside, article = self._kind(tag, attrs, aside, article)
        if not top and tag in HOLDERS and tag not in ("html", "body"):
            top = self.count
        self.open.append((tag, self.count, aside, article, link or tag == "a", top))

    def _kind(self, tag: str, attrs: str, aside: bool, article: int) -> tuple[bool, int]:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if "=" in attrs else {}
        role, words = found.get("role", "").lower(), _words(found.get("class", "") + " " + found.get("id", "")) if self.by_name and tag not in ("html", "body") else set()
        sure = 3 if tag == "article" or "articleBody" in found.get("itemprop", "") else 2 if tag == "main" or role in ("main", "article") else 0
        if tag in ASIDE or role in ASIDE_ROLES or (tag == "header" or "header" in words and not sure) and not article:
            aside = True
        elif words & ASIDE_WORDS and not (sure and not words & {"comment", "comments", "reply", "teaser", "related"}):
            aside = True
        elif HIDDEN.search(QUOTED.sub("", attrs)) or NO_DISPLAY.search(found.get("style", "")):
            aside = True
        if not sure and not article and words & ARTICLE_WORDS and tag in ("div", "section", "td"):
            sure = 1
        if not aside and sure > self.marked.get(article, 0):
            self.marked[self.count] = sure
            article = self.count
        return aside, article


def main_lines(page: str, window: int = 3, least: int = 80) -> list[str]:
    """The main text's lines. A page all of whose text is set aside is read again without regard to class and id names."""
    return _main_lines(_Page(page).lines, window, least) or _main_lines(_Page(page, False).lines, window, least)


def _main_lines(lines: list[tuple[str, bool, int, int, int, int]], window: int, least: int) -> list[str]:
    marked = any(line[4] and not line[1] for line in lines)
    # outside the marked elements, or on a page without them mostly links: zero
    none = (lambda line: not line[4]) if marked else (lambda line: line[2] * 5 > len(line[0]) * 3)
    lines = [line for line in lines if not line[1] and not none(line)]
    sized = [len(line[0]) for line in lines]
    sums = [max((sum(sized[max(0, k - o) : max(0, k - o) + window]) for o in range(window)), default=0) for k in range(len(sized))]
    stretches, at = [], 0
    while at < len(sums):
        surge = at
        while at < len(sums) and sums[at] >= least:
            at += 1
        if at > surge:
            stretches.append((surge, at))
        at += 1
    if not stretches:  # no surge anywhere: a short page is its lines
        return [line[0] for line in lines]
    if not marked:
        best = max(stretches, key=lambda x: (sum(sized[x[0] : x[1]]), -x[0]))
        blocks = {line[5] for line in lines[best[0] : best[1]]}
        stretches = [x for x in stretches if any(line[5] in blocks for line in lines[x[0] : x[1]])]
    place = 4 if marked else 3
    homes = {line[place] for surge, dive in stretches for line in lines[surge:dive]}
    inside = [k for k, line in enumerate(lines) if line[place] in homes]
    return [line[0] for line in lines[inside[0] : inside[-1] + 1]]


def _extract(batches):
    for batch in batches:
        texts = ["\n".join(main_lines(page)) if page else "" for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = rows.mapInArrow(_extract, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
    return found.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
