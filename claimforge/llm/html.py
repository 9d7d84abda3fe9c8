"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser turns a page into a stream of events. Block elements cut it into lines; each
line has its text, its number of tags and the container that holds it. The text-to-tag ratios of all
lines of the page are smoothed with a Gaussian and clustered by the threshold of their standard
deviation. Containers with lines above it are content regions, with what is nested in them and the
headings and paragraphs that stand directly in what holds them; so short paragraphs, headings and lists of
a region stay, and other containers go, as do lists of short links of which most lines are below. If regions
lie in article or main elements, only those stay; of several side by side all but teasers, which have much of
their text in links or no line above the threshold.

From the regions, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are pruned: by element and role, and by a class or id of which every word is on a list. What is pruned
inside a line goes from it, and the rest of the line stays. A form goes but for an article in it, or if it holds most of
the page's running text; its labels and controls always go. If pruning takes all lines above the threshold, the other
lines of the page are clustered alone.

Edge cases: null or empty html gives an empty text; unclosed elements end with their parent or the page;
a page cut off inside a tag loses that tag only; repeated rows give equal rows; an empty table gives an
empty result. Columns other than page_id, url and html are ignored. Time is linear in the page, however
deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices

SIGMA = 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
FURNITURE = frozenset("aside button canvas dialog footer head header iframe label legend menu nav noscript object script select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Class and id values are taken apart at spaces; one of which every word is here, and one at least in MARKS, marks.
MARKS = frozenset("ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split())
GENERIC = frozenset("area articles bar block bottom box buttons container count form global group inner items left links list main navi outer page panel posts primary right secondary section site slot stories text thread top user users reader readers widgets wrap wrapper".split())
#: A word that is comment or comments behind a short prefix is a mark too.
COMMENTS = re.compile("[a-z]{0,3}comments?")
#: Marks only outside an article.
OUTSIDE = frozenset("header masthead".split())
CONTENT = frozenset(("article", "main"))
#: Elements that are lines of their container.
INLINE_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th option hr".split())
#: A container of which most lines are below the threshold goes if so much of its text is links, in LINK_LINES lines or more.
LINK_SHARE, LINK_LINES = 0.6, 3
#: But not one of lines this long, as references are.
LINK_CHARS = 40
#: An article beside a longer one is a teaser if so much of its text is links.
TEASER_SHARE = 0.2
#: A form that holds most of the page's text holds its content if a line of it has so many words.
FORM_WORDS = 20


class Element(NamedTuple):
    name: str = ""
    #: Furniture by element or role, and that or a mark.
    hard: bool = False
    furniture: bool = False
    #: Numbers of the article or main around, of the container, and of the form around; 0 if there is none.
    content: int = 0
    holder: int = 0
    form: int = 0
    link: bool = False
    #: In furniture that stands in a line: blocks in it don't end the line.
    inset: bool = False


class Line(NamedTuple):
    text: str
    tags: int
    holder: int
    furniture: bool
    content: int
    linked: int
    form: int


class Lines(HTMLParser):
    """lines in page order; up: the container around each container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.up: list[int] = [0]
        self._open: list[Element] = [Element()]
        self._names: Counter[str] = Counter()
        #: Pieces of the line, each with the element it stands in.
        self._pieces: list[tuple[str, Element]] = []
        self._tags = self._forms = 0

    def _end_line(self) -> None:
        own = [p for p in self._pieces if not p[1].furniture]
        text = " ".join("".join(t for t, _ in own).split())
        if not text:
            own = [p for p in self._pieces if p[1].furniture]
            text = " ".join("".join(t for t, _ in own).split())
        if text:
            at = next(e for t, e in own if t.strip())
            self.lines.append(Line(text, max(1, self._tags), at.holder, at.furniture, at.content, sum(len(t) for t, e in own if e.link), at.form))
        self._pieces, self._tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and not self._open[-1].inset:
            self._end_line()
        elif tag in BLOCK or tag == "br":
            self._pieces.append((" ", self._open[-1]))
        self._tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self._open[-1].name == tag:
            self._names[self._open.pop().name] -= 1  # its end tag may be left out
        at = self._open[-1]
        _, hard, furniture, content, holder, form, link, inset = at
        values = dict(attrs)
        body = tag in ("html", "body")
        if tag in CONTENT and not content:
            furniture, form = hard, 0  # a class or a form around the article is no mark for it
        hard = hard or tag in FURNITURE or not body and ("hidden" in values or values.get("role") in ROLES)
        furniture = furniture or hard or not body and self._marked(values, bool(content))
        inset = inset or furniture and not at.furniture and tag not in BLOCK
        if tag == "form" and not form:
            self._forms += 1
            form = self._forms
        if tag in BLOCK and tag not in INLINE_BLOCK and not inset:
            self.up.append(holder)
            holder = len(self.up) - 1
        if tag in CONTENT and not content:
            content = holder
        self._names[tag] += 1
        self._open.append(Element(tag, hard, furniture, content, holder, form, link or tag == "a", inset))

    @staticmethod
    def _marked(values: dict[str, str | None], in_content: bool) -> bool:
        marks = MARKS if in_content else MARKS | OUTSIDE
        for token in f"{values.get('class') or ''} {values.get('id') or ''}".lower().split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            told = [w in marks or bool(COMMENTS.fullmatch(w)) for w in words]
            if any(told) and all(t or w in GENERIC for t, w in zip(told, words, strict=True)):
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        ends = tag in BLOCK and not self._open[-1].inset
        if ends:
            self._end_line()
        if self._names[tag] > 0:
            name = ""
            while name != tag:
                name = self._open.pop().name
                self._names[name] -= 1
        if tag in BLOCK and not ends:
            # The element around ends with what was left open in it, or a block in an inset does.
            if self._open[-1].inset:
                self._pieces.append((" ", self._open[-1]))
            else:
                self._end_line()

    def handle_data(self, data: str) -> None:
        if not (self._names["script"] or self._names["style"] or self._names["template"]):
            self._pieces.append((data, self._open[-1]))

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the values are mirrored."""
    reach = min(int(3 * sigma + 0.5), len(values) - 1)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, "symmetric"), kernel / kernel.sum(), "valid")


def _chosen(lines: list[Line], sigma: float) -> np.ndarray:
    """Whether each line's smoothed ratio reaches the threshold."""
    ratio = smoothed(np.array([len(x.text) / x.tags for x in lines]), sigma)
    return ratio >= min(ratio.std(), ratio.max())


def _without_forms(lines: list[Line]) -> list[Line]:
    """Lines of forms are furniture, but of a form with a long line that holds most of the page's text."""
    weight, long = Counter(), set()
    for x in lines:
        if not x.furniture:
            weight[x.form] += len(x.text)
            if len(x.text.split()) >= FORM_WORDS:
                long.add(x.form)
    own = {f for f in long if f and 2 * weight[f] > weight.total()}
    return [x._replace(furniture=True) if x.form and x.form not in own else x for x in lines]


def _kept_holders(lines: list[Line], chosen: list[bool], up: list[int]) -> set[int]:
    """Containers of which the lines stay: those with chosen lines, those around and those in them."""
    linked, total, count, above = Counter(), Counter(), Counter(), Counter()
    for x, c in zip(lines, chosen, strict=True):
        linked[x.holder] += x.linked
        total[x.holder] += len(x.text)
        count[x.holder] += 1
        above[x.holder] += c
    # Smoothing lifts the ends of a list of links beside a paragraph.
    lists = {h for h in total if linked[h] > LINK_SHARE * total[h] and count[h] >= LINK_LINES and total[h] < LINK_CHARS * count[h] and 2 * above[h] < count[h]}
    own = {h for h in total if above[h]} - lists
    if not own:
        own, lists = {h for h in total if above[h]}, set()
    kept = set(own)
    for h in own:
        while h and (h := up[h]) not in kept:
            kept.add(h)
    inside: dict[int, bool] = {}
    for h in total:
        way = []
        while h and h not in own and h not in inside:
            way.append(h)
            h = up[h]
        found = h in own or inside.get(h, False)
        for w in way:
            inside[w] = found
    return (kept | {h for h, found in inside.items() if found}) - lists


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    parser = Lines()
    # A tag that the end of the page cuts off is no text.
    parser.feed(re.sub(r"<[/!?a-zA-Z][^<>]*\Z", "", html or ""))
    parser.close()
    lines = _without_forms(parser.lines)
    if all(x.furniture for x in lines):
        return ""
    chosen = _chosen(lines, sigma)
    if not any(c and not x.furniture for x, c in zip(lines, chosen, strict=True)):
        lines = [x for x in lines if not x.furniture]
        chosen = _chosen(lines, sigma)
    pairs = [(x, bool(c)) for x, c in zip(lines, chosen, strict=True) if not x.furniture]
    weight, total, linked = Counter(), Counter(), Counter()
    for x, c in pairs:
        total[x.content] += len(x.text)
        linked[x.content] += x.linked
        if c and x.content:
            weight[x.content] += len(x.text)
    if weight:
        most = max(weight, key=lambda k: (weight[k], -k))
        full = {k for k in weight if k == most or linked[k] < TEASER_SHARE * total[k]}
        pairs = [p for p in pairs if p[0].content in full]
    lines, flags = [x for x, _ in pairs], [c for _, c in pairs]
    kept = _kept_holders(lines, flags, parser.up)
    return "\n\n".join(x.text for x in lines if x.holder in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(_extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
