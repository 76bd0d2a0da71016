"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, clustering.

The standard library's parser streams a page once. Every block element begins a new line
(parsed pages rarely keep line feeds that mean anything); a line knows its characters, its
characters inside links and its tags. Text that markup itself marks as something else
(menus, forms, scripts, notices, comments of readers ...) is set aside while parsing. The
ratios of text to tags are smoothed over the neighbouring lines and parted in two clusters;
the content regions are the lines above the threshold, or all that an article element
holds where the page declares one. Left-out end tags cost no text: what can't stand in a head ends
it, and an element that is never closed sets nothing aside from the article on.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from lexigrade.llm.common import bounded

# Element names of the HTML standard, by the part they play here.
DROPPED = {
    "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "option",
    "textarea", "input", "label", "fieldset", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "map",
    "head", "title", "menu", "dialog", "datalist", "noframes", "applet",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "title", "tr", "ul",
}
#: What a head may hold; anything else ends it, but inside the elements that need their own end tag.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"}
CLOSED_BY_HAND = {"title", "noscript", "noframes", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words of class, id and role that name parts beside the article.
BESIDE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored",
    "sponsors", "promo", "promotion", "promoted", "outbrain", "taboola", "nav", "navbar", "navigation", "menu", "submenu",
    "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "topbar", "toolbar", "header", "masthead", "footer", "foot",
    "colophon", "copyright", "legal", "sidebar", "side", "aside", "rail", "widget", "widgets", "related", "recommended",
    "recommendations", "share", "sharing", "social", "follow", "newsletter", "subscribe", "subscription", "signup",
    "login", "signin", "register", "search", "searchbox", "form", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "notification", "alert", "disclaimer", "popup", "modal", "overlay", "paywall", "comment", "comments",
    "commentlist", "disqus", "replies", "reply", "respond", "discussion", "feedback", "hidden", "skip", "contentinfo",
    "complementary", "alertdialog", "dialog", "tablist",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "tablist"}
#: Blocks that stand beside others of their kind in the element that holds an article.
PARAGRAPHS = {"p", "pre"}
# Words among these that parts of an article are called by too (side effects, legal analysis).
OWN = {
    "side", "legal", "discussion", "feedback", "notice", "notices", "form", "search", "follow", "register", "reply", "replies",
    "respond", "rail", "foot", "alert", "social", "header", "disclaimer", "copyright", "dialog", "subscription", "consent",
    "notification", "promotion", "advertising", "navigation", "recommended", "recommendations", "share", "sharing", "comment", "skip",
}
# Words that only say that an element is one.
BOXES = {
    "box", "area", "wrap", "wrapper", "container", "block", "section", "list", "bar", "panel", "links", "link", "buttons", "button",
    "item", "items", "inner", "outer", "module", "left", "right", "top", "bottom", "form", "icons", "content", "group", "row", "col",
}
#: What lists, tables and quotes are made of.
LISTED = {
    "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "figure", "figcaption",
    "p", "pre",
}
#: A class like `has-sidebar` speaks of another element.
ABOUT = {"has", "with", "no", "without"}
_PARTS = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
_SPACE = re.compile(r"\s+")
#: Lines to each side that weigh in, as the standard deviation of the Gaussian.
SIGMA = 1.0


class Lines(HTMLParser):
    """Streams one page into lines: [text parts, characters in links, tags, declared, heading, block].

    A line is declared 2 in an article element, 1 in a main element alone, else 0.

    Elements and blocks are known by their number in page order, -1 is the page. `void` are those that
    set nothing aside once an article begins: see `unclosed`.
    """

    def __init__(self, void: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = [[[], 0, 1, 0, False, -1]]
        self.open: list[tuple[str, bool, int]] = []  # element, whether its content is set aside, number
        self.at: dict[str, list[int]] = defaultdict(list)  # where open elements of a name stand in `open`
        self.fences: list[int] = []  # where blocks stand that an inner block doesn't end
        self.scanned = 0  # how much of `open` has been asked for what sets an article aside
        self.kinds: list[str] = []
        self.within: list[int] = []  # the block around each element
        self.aside = self.article = self.declared = self.link = self.heading = 0
        self.void, self.shown = void, False
        self.around: set[int] = set()  # elements that set an article aside
        self.shut: set[int] = set()  # elements set aside that have their end tag

    def unclosed(self) -> frozenset[int]:
        """Elements that set an article aside and never end."""
        return frozenset(self.around - self.shut)

    def _line(self) -> None:
        if self.lines[-1][0]:
            self.lines.append([[], 0, 1, 0, False, -1])

    def _block(self) -> int:
        if not self.open:
            return -1
        tag, _, number = self.open[-1]
        return number if tag in BLOCKS else self.within[number]

    def _end_head(self, tag: str) -> None:
        """`tag` begins: an open head ends before what it can't hold."""
        for k, (name, _, _) in enumerate(self.open[:3]):
            if name == "head":
                if tag == "body" or not any(self.at[inner] and self.at[inner][-1] > k for inner in CLOSED_BY_HAND):
                    self._close(k)
                return

    def _show(self) -> None:
        """The page's article begins: what never ends doesn't set it aside."""
        for k in range(self.scanned, len(self.open)):
            tag, beside, number = self.open[k]
            if beside and number in self.void:
                self.open[k] = (tag, False, number)
                self.aside -= 1
            elif beside:
                self.around.add(number)
        self.scanned = len(self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._end_head(tag)
        if tag in BLOCKS:
            self._line()
        self.lines[-1][2] += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_implied(tag)
        label = tag == "label" and self.article > 0 and bool(self.at["p"])  # a word of a paragraph
        beside = (tag in DROPPED and not label) or (tag not in ("html", "body", "main") and named_beside(attrs, tag))
        if tag in ("article", "main") and not beside and not self.shown:
            if self.aside:
                self._show()
            self.shown = tag == "article" and not self.aside
        block = self._block()
        self.at[tag].append(len(self.open))
        if tag in BLOCKS and tag != "p":
            self.fences.append(len(self.open))
        self.open.append((tag, beside, len(self.kinds)))
        self.kinds.append(tag)
        self.within.append(block)
        self._count(tag, beside, 1)

    def _count(self, tag: str, beside: bool, by: int) -> None:
        self.aside += by * beside
        self.link += by * (tag == "a")
        self.heading += by * (tag in HEADINGS)
        if tag in ("article", "main"):
            self.article += by
            self.declared += by * (tag == "article")

    def _close_implied(self, tag: str) -> None:
        """A block of one kind ends its open sibling: `<p>` after `<p>`, `<li>` after `<li>`."""
        ends = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
        last = max((self.at[name][-1] for name in ends if self.at[name]), default=-1)
        if last >= (self.fences[-1] if self.fences else 0):
            self._close(last)

    def _close(self, k: int) -> None:
        """Closes all open elements from the `k`th on. Every element is closed once, so a page is read in linear time."""
        for name, beside, _ in reversed(self.open[k:]):
            self._count(name, beside, -1)
            self.at[name].pop()
        while self.fences and self.fences[-1] >= k:
            self.fences.pop()
        self.scanned = min(self.scanned, k)
        del self.open[k:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._line()
        self.lines[-1][2] += 1
        if self.at[tag]:
            k = self.at[tag][-1]
            if self.open[k][1]:
                self.shut.add(self.open[k][2])
            self._close(k)
        if tag in BLOCKS:
            self._line()

    def handle_data(self, data: str) -> None:
        if self.aside and self.open[-1][0] == "head" and not data.isspace():
            self._end_head("")
        if self.aside or not data:
            return
        line = self.lines[-1]
        if not line[0] and data.isspace():
            return
        if not line[0]:
            line[5] = self._block()
        line[0].append(data)
        if self.link:
            line[1] += len(data)
        line[3] = max(line[3], (self.article > 0) + (self.declared > 0))
        line[4] = line[4] or self.heading > 0


def beside_name(name: str) -> bool:
    """Whether one class or id names a part beside the article.

    Words that an article's own parts are called by too count only as what the name is about: its
    last word but for those that just say box.
    """
    words = [word.lower() for word in _PARTS.findall(name)]
    if ABOUT.intersection(words):
        return False
    about = len(words)
    while about > 1 and (words[about - 1] in BOXES or words[about - 1].isdigit()):
        about -= 1
    return any(word in BESIDE and (word not in OWN or k == about - 1) for k, word in enumerate(words))


def named_beside(attrs: list[tuple[str, str | None]], tag: str = "div") -> bool:
    """Whether class, id, role or a hidden mark say that the element isn't part of the article.

    What a paragraph or a heading is called doesn't.
    """
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
        if name == "role" and value and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id") and value and tag not in PARAGRAPHS and tag not in HEADINGS:
            if any(map(beside_name, value.split())):
                return True
    return False


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian-weighted means over the neighbouring values."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Where two clusters on a line part (two means, begun at the extremes); the least value if all are alike."""
    low, high = min(values), max(values)
    if high <= 2 * low:
        return low
    for _ in range(50):
        middle = (low + high) / 2
        below = [v for v in values if v < middle]
        above = [v for v in values if v >= middle]
        if not below or not above:
            break
        new = (sum(below) / len(below), sum(above) / len(above))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def extract(html: str) -> str:
    """The article's text: blocks in page order, white space folded, joined by one space."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    if parser.unclosed():
        parser = Lines(parser.unclosed())
        parser.feed(html)
        parser.close()
    lines = [(t, *line[1:]) for line in parser.lines if (t := _SPACE.sub(" ", "".join(line[0])).strip())]
    if not lines:
        return ""
    own = [math.log1p(max(len(t) - linked, 0) / tags) for t, linked, tags, *_ in lines]
    ratios = smooth(own)
    bar = threshold(ratios)
    links = [2 * linked > len(text) for text, linked, *_ in lines]
    declared = [sum(len(line[0]) for line in lines if line[3] == k) for k in range(3)]
    if declared[1] or declared[2]:
        # The article is declared: all its lines belong to the content, lists of links too. Where both
        # are there, an article with the better part of main's text is it.
        bar = 2 if declared[2] >= declared[1] else 1
        kept = [line[3] >= bar for line in lines]
    else:
        # A region begins and ends with a line above the bar before and after smoothing.
        kept = [min(ratio, mine) >= bar and not link for ratio, mine, link in zip(ratios, own, links)]
        if any(kept):
            # It takes in what lies between, the paragraphs beside its own in the same element, and
            # the headings before it. Linked lines belong to it where they lie between in such an element.
            first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
            blocks = [line[5] for line in lines]
            kinds = ["" if b < 0 else parser.kinds[b] for b in blocks]
            homes = [parser.within[b] if kind in PARAGRAPHS or kind in HEADINGS else b for b, kind in zip(blocks, kinds)]
            own_homes = {home for home, core in zip(homes, kept) if core}
            inside = {-1: -1 in own_homes}

            def at_home(block: int) -> bool:
                path = []
                while block not in inside and block not in own_homes:
                    path.append(block)
                    block = parser.within[block]
                found = block in own_homes or inside[block]
                inside.update(dict.fromkeys(path, found))
                return found

            listed = {-1: False}

            def in_list(block: int) -> bool:
                """Whether nothing but lists, tables and quotes lies between the block and the region's element."""
                path = []
                while block not in listed and parser.kinds[block] in LISTED and parser.within[block] not in own_homes:
                    path.append(block)
                    block = parser.within[block]
                found = listed[block] if block in listed else parser.kinds[block] in LISTED
                listed.update(dict.fromkeys([*path, block], found))
                return found

            kept = [
                (not link or at_home(block)) if first <= k <= last else not link and (kind in PARAGRAPHS and home in own_homes or in_list(block))
                for k, (link, block, kind, home) in enumerate(zip(links, blocks, kinds, homes))
            ]
            first = kept.index(True)
            while first and lines[first - 1][4] and not links[first - 1]:
                first -= 1
                kept[first] = True
        else:
            kept = [ratio >= bar and not link for ratio, link in zip(ratios, links)]
    return " ".join(line[0] for line, keep in zip(lines, kept) if keep)


def main_text(pages: DataFrame) -> DataFrame:
    """Every row of `pages` (page_id, url, html) as page_id, url, text, n_chars.

    Whole pages, one task each for its rows and no shuffle. Null or empty html gives the empty
    text, as does a page whose text is all beside the article. A declared article is kept whole but for what
    markup sets aside in it; broken markup is read as far
    as the parser can. Other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            found = [extract(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    return pages.select(pages["page_id"], pages["url"], pages["html"].cast("string").alias("html")).mapInArrow(
        scan, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
