"""HTML main-text extraction: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags. Each block is described by its word
count and link density, those of its neighbours, the kind of elements it stands in, and what
the names of its containers hint at (a name may mean boilerplate, or only hold a word that can);
a decision tree trained on the labelled table below says which blocks are main text. A page is
read in time linear in its length, however deep its containers are nested.

Defined results: null and empty html have no blocks and an empty text; unclosed comments and
scripts run to the end of the page; a sole < is text; repeated rows each give a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: HTML's elements by what they mean for text.
RAW = frozenset("script style noscript template textarea iframe noembed noframes title desc metadata defs symbol annotation annotation-xml object canvas audio video select head".split())
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article header footer nav aside main form fieldset legend blockquote pre figure figcaption hr address details summary body html dialog center menu search button label option".split())
CONTAINER = frozenset("div section article header footer nav aside main form fieldset ul ol dl table blockquote figure details dialog body menu search td li span center address button label".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers that are not main text, and what names in class, id and role hint at.
BOILER_TAGS = frozenset("nav aside footer form fieldset dialog menu search button label".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promoted banner cookie cookies consent gdpr notification popup modal overlay "
    "sidebar aside nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer copyright comment comments commentlist reply replies discussion disqus respond "
    "related recommended recommendations trending teaser widget newsletter subscribe subscription signup login masthead topbar complementary contentinfo disclaimer outbrain taboola toc paywall".split()
)
#: Names that hint at boilerplate alone, but stand in names of articles too (side-effects, social-science).
UNSURE_NAMES = frozenset("side social legal follow search notice notices form skip alert foot menu rail promotion popular share sharing response responses".split())
#: Words that say nothing of what a named container holds.
LAYOUT_NAMES = frozenset("container wrapper wrap box area block section item items list left right top bottom inner outer bar link links icon icons button buttons panel group region zone slot unit holder content body text info".split())
ARTICLE_NAMES = frozenset("article post entry story content main body text prose".split())
#: In has-sidebar or comments-open the name tells what a page has, not what the container is.
BEFORE_NAMES = frozenset("has with no without hide show enable enabled disable disabled".split())
AFTER_NAMES = frozenset("open closed enabled disabled".split())


@dataclass
class Block:
    text: str
    words: int
    density: float
    boiler: bool
    hint: int  # 2: a name that means boilerplate, 1: a name that may, 0: no such name
    article: bool
    heading: bool
    label: bool = False


@dataclass(slots=True)
class _Open:
    tag: str
    boiler: bool  # a boilerplate element, or hidden
    article: bool
    hint: int
    whole: bool  # an article or main element that no name speaks against
    up: _Open | None = None  # the next open container with a hint
    main: bool = False  # a main element stands in it
    plain: int = 0  # unlinked letters of whole elements in it
    left: int = 0  # its hint, unless it is a layout wrapper


class _Page:
    """What is read of a page so far. Opening, closing and reading a block take constant time
    whatever the depth: containers hand their sums to the one around them when they close."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.stack: list[_Open] = []
        self.open: dict[str, int] = {}  # open containers by tag
        self.whole: list[int] = []  # places of whole elements on the stack
        self.hinted: list[_Open] = []  # containers with a hint, in the order they open
        self.inside: _Open | None = None  # the innermost of them that is open
        self.marks: list[tuple[Block, _Open]] = []
        self.linked = self.boilers = self.articles = self.heading = self.plain = self.hint = 0
        self.label = self.spoiled = False  # spoiled: the open block itself is hidden

    def enter(self, o: _Open) -> None:
        if o.hint:
            o.up, self.inside = self.inside, o
            self.hinted.append(o)
        if o.whole:
            self.whole.append(len(self.stack))
            if o.tag == "main" and self.stack:
                self.stack[-1].main = True
        self.boilers += o.boiler
        self.articles += o.article
        self.open[o.tag] = self.open.get(o.tag, 0) + 1
        self.stack.append(o)

    def leave(self) -> None:
        o = self.stack.pop()
        self.open[o.tag] -= 1
        self.boilers -= o.boiler
        self.articles -= o.article
        if o.hint:
            self.inside = o.up
        if o.whole:
            self.whole.pop()
        if self.stack:
            self.stack[-1].plain += o.plain
            self.stack[-1].main |= o.main

    def flush(self) -> None:
        """End the open block."""
        text = "".join(self.parts)
        shown = " ".join(text.split())
        if shown:
            letters = len("".join(text.split()))
            boiler = self.boilers > 0 or self.spoiled
            block = Block(shown, shown.count(" ") + 1, min(1.0, self.linked / letters), boiler, self.hint, self.articles > 0, self.heading > 0, self.label)
            self.blocks.append(block)
            if not boiler:
                if not self.hint:
                    plain = max(0, letters - self.linked)
                    self.plain += plain
                    if self.whole and self.whole[-1]:
                        self.stack[self.whole[-1] - 1].plain += plain
                if self.inside:
                    self.marks.append((block, self.inside))
        self.parts, self.linked = [], 0

    def finish(self) -> list[Block]:
        """All blocks. A container that holds the page's main element or the bulk of its text in
        articles is a layout wrapper, whatever its name."""
        self.flush()
        while self.stack:
            self.leave()
        for o in self.hinted:
            own = 0 if o.main or 2 * o.plain > self.plain else o.hint
            o.left = max(own, o.up.left if o.up else 0)
        for block, o in self.marks:
            block.hint = max(block.hint, o.left)
        return self.blocks


def _tokens(attributes: str):
    """The words of each name in class, id and role, without what says what the page has."""
    for m in ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            names = [n.lower() for n in NAME.findall(token)]
            if len(names) > 1 and (names[0] in BEFORE_NAMES or BEFORE_NAMES & set(names[1:-1])):
                names = names[: next(i for i, n in enumerate(names) if n in BEFORE_NAMES)]
            elif len(names) > 1 and names[-1] in AFTER_NAMES:
                names = []
            yield names


def name_hint(attributes: str, article: bool = False) -> int:
    """2 if a name means boilerplate (sidebar, cookie-notice, legal), 1 if it may (legal-news),
    else 0. An ``article`` element is spoken against by names of nothing else only."""
    best = 0
    for names in _tokens(attributes):
        said = [n for n in names if n not in LAYOUT_NAMES]
        sure = BOILER_NAMES.intersection(said)
        if article:
            best = max(best, 2 if sure and len(sure) == len(set(said)) else 0)
        elif sure:
            return 2
        elif UNSURE_NAMES.intersection(said):
            best = max(best, 2 if UNSURE_NAMES.issuperset(said) else 1)
    if best == 1 and any(names in (["article"], ["post"], ["entry"], ["story"]) for names in _tokens(attributes)):
        return 0
    return best


def _container(tag: str, attributes: str, page: _Page) -> _Open:
    boiler = tag in BOILER_TAGS or tag == "header" and not page.articles or bool(attributes and HIDDEN.search(attributes))
    if boiler or tag in ("main", "body"):
        hint = 0
    else:
        hint = name_hint(attributes, tag == "article") if attributes else 0
    article = not boiler and hint < 2 and tag in ("article", "main")
    if not article and not boiler and hint < 2 and attributes and tag in ("div", "section", "td"):
        article = any(ARTICLE_NAMES.intersection(names) for names in _tokens(attributes))
    return _Open(tag, boiler, article, hint, article and not hint and tag in ("article", "main"))


def blocks(html: str) -> list[Block]:
    """Flat text blocks of a page, in order."""
    page = _Page()
    links = breaks = at = 0
    n = len(html)
    missing: set[str] = set()  # end tags that do not follow any more

    def find(key: str, pattern: str):
        m = None if key in missing else re.compile(pattern, re.I).search(html, at)
        if not m:
            missing.add(key)
        return m

    while at < n:
        lt = html.find("<", at)
        end = n if lt < 0 else lt
        if end > at:
            text = html[at:end]
            if "&" in text:
                text = unescape(text)
            page.parts.append(text)
            solid = len("".join(text.split()))
            if solid:
                breaks = 0
            if links:
                page.linked += solid
        if lt < 0:
            break
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            stop = html.find(">", lt)
            at = n if stop < 0 else stop + 1
            continue
        m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if not m:
            page.parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1] == "/", m[2].lower(), m[3]
        if tag in RAW and not closing and not attributes.endswith("/"):
            if tag in BLOCK or tag == "head":
                page.flush()
            stop = find(tag, rf"</{tag}(?=[\s/>])")
            if tag == "head" and not stop:  # an unclosed head ends where the body begins
                stop = find("<body", r"(?=<body[\s>])")
                at = stop.start() if stop else at
                continue
            close = html.find(">", stop.end()) if stop else -1
            at = n if close < 0 else close + 1
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
        elif tag == "br":
            breaks += 1
            page.parts.append(" ")
            if breaks == 2:
                page.flush()
        elif tag in BLOCK or tag in CONTAINER:
            if tag in BLOCK:
                page.flush()
                breaks = 0
                if tag in HEADINGS:
                    page.heading = 0 if closing else 1
                page.label = not closing and " data-main" in attributes
                own = not closing and attributes != "" and tag not in CONTAINER
                page.spoiled = bool(own and HIDDEN.search(attributes))
                page.hint = name_hint(attributes) if own else 0
            if tag in CONTAINER:
                if closing:
                    if page.open.get(tag):
                        if tag not in BLOCK:
                            page.flush()
                        while page.stack[-1].tag != tag:
                            page.leave()
                        page.leave()
                elif not attributes.endswith("/"):
                    o = _container(tag, attributes, page)
                    if tag not in BLOCK and (o.boiler or o.hint):
                        page.flush()
                    page.enter(o)
    return page.finish()


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "boiler", "hint", "article", "heading")


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES a block; beyond the page's ends there are 0 words, all linked."""
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([1, *(b.density for b in found), 1], float)
    flags = np.array([(b.boiler, b.hint, b.article, b.heading) for b in found], float).reshape(-1, 4)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], flags])


#: The labelled table: pages of lines "container... tag words linked_words label".
TABLE = """
nav li 1 1 0
nav li 2 2 0
div.ad p 9 0 0
article h1 8 0 1
article p 60 0 1
article p 4 0 1
article p 33 2 1
footer p 9 0 0

header div 3 3 0
header h1 4 0 0
nav a 1 1 0
main h2 5 0 1
main p 1 0 1
main p 90 4 1
main div.share p 4 4 0
main aside p 25 3 0
main ul li 6 0 1
main section.comments p 40 0 0
aside.sidebar p 18 6 0
footer p 12 4 0

div.menu li 2 2 0
div p 55 0 1
div p 70 3 1
div p 12 0 1
div p 44 1 1
div li 5 5 0
div li 4 4 0
div p 3 3 0

div.cookie-notice p 30 2 0
form p 14 0 0
article p 2 0 1
article blockquote p 21 0 1
article p 120 0 1
article div.related li 7 7 0
section.comments h3 2 0 0
section.comments p 65 0 0
div#footer p 20 5 0

div a 1 1 0
div a 2 2 0
div h1 7 0 1
div p 38 0 1
div p 51 0 1
div p 26 0 1
div p 4 4 0
div p 6 0 0
footer p 8 0 0

table.layout div 3 3 0
td div 48 0 1
td div 61 2 1
td div 35 0 1
td li 3 3 0
td div 5 2 0

div.content h1 6 0 1
div.content p 10 0 1
div.content p 3 0 1
div.content p 80 1 1
div.content div.promo p 22 1 0
div.content form label 3 0 0
div.content p 17 0 1
div.content table td 2 0 1
div.newsletter p 16 0 0
div p 5 5 0

header.masthead p 40 0 0
article header h1 9 0 1
article header p 12 0 1
article p 75 0 1
article footer p 10 1 0
article nav li 2 2 0
article ul li 9 9 1
article p 6 6 1
aside p 80 0 0
div.banner p 60 0 0

div li 3 3 0
div li 6 6 0
div li 8 8 0
div p 9 9 0
article h2 4 4 1
article p 2 2 1
article p 50 0 1
article li 3 3 1
article li 5 5 1
article p 1 1 1
article h3 2 0 1
article p 3 0 1
div p 2 0 0
div p 4 0 0
div p 3 0 0

div p 5 0 0
div li 4 4 0
div h1 8 0 1
div p 47 0 1
div p 9 0 1
div p 66 0 1
div h2 3 0 1
div p 58 2 1
div p 3 0 0
div li 6 6 0
div li 7 7 0
div p 10 10 0

div h2 4 0 1
div p 64 0 1
div p 1 0 0
div p 2 2 0
div li 3 3 0
div h2 5 0 1
div p 41 0 1
div p 90 3 1

nav li 2 2 0
section#side-effects p 40 0 1
section#side-effects p 35 1 1
section#side-effects p 18 0 1
div.social-channels li 2 2 0
div.follow-us p 6 3 0
div.skip-ahead p 3 3 0

div.social-science h1 5 0 1
div.social-science p 44 0 1
div.social-science p 60 2 1
div.social-science p 14 0 1
div.share-this p 3 0 0
div.legal-links p 14 4 0

div.search-tips p 33 0 1
div.search-tips p 52 0 1
div.search-again p 4 0 0
div.popular-now li 8 8 0
div.popular-now li 7 7 0
div.notice p 44 0 0
div.form-help p 5 0 0
div#responses p 48 0 0
div#responses p 31 1 0

div h1 4 0 1
div p 60 9 1
div p 45 12 1
div p 80 22 1
div p 30 6 1
div p 25 4 1
div p 12 9 0
div p 14 12 0
div p 24 20 0
div li 9 7 0
footer p 40 6 0
div.related p 30 8 0
div.social-channels p 13 7 0

article p 60 0 1
article p 3 0 1

article h1 3 0 1
article p 5 0 1
footer p 4 0 0

article p 2 0 1
article p 6 0 1
article p 4 0 1
nav li 1 1 0

div p 5 0 0
div p 3 0 0
div p 4 4 0

div p 2 0 0
div p 6 6 0

article.menu-planning p 50 0 1
article.menu-planning address 6 0 1
article.comment p 35 0 0
div.alert p 28 0 0
"""


def _wrapped(name: str, text: str) -> str:
    tag, sign, value = re.match(r"(\w+)([.#]?)(.*)", name).groups()
    attribute = {"": "", ".": f' class="{value}"', "#": f' id="{value}"'}[sign]
    return f"<{tag}{attribute}>{text}</{tag}>"


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table's blocks."""
    xs, ys = [], []
    for page in TABLE.strip().split("\n\n"):
        html = ""
        for line in page.split("\n"):
            *containers, tag, n, linked, label = line.split()
            n, linked = int(n), int(linked)
            text = "word " * (n - linked) + (f"<a>{'link ' * linked}</a>" if linked else "")
            if tag == "a":
                tag = "div"
            part = f"<{tag}{' data-main' * int(label)}>{text}</{tag}>"
            for c in reversed(containers):
                part = _wrapped(c, part)
            html += part
        found = blocks(html)
        xs.append(features(found))
        ys.append(np.array([b.label for b in found]))
    return np.concatenate(xs), np.concatenate(ys)


@dataclass(frozen=True)
class Tree:
    """A node splits on feature <= limit; a leaf has feature -1 and a verdict."""

    feature: int
    limit: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    verdict: bool = False

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.verdict)
        out = np.empty(len(x), bool)
        low = x[:, self.feature] <= self.limit
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """CART by Gini impurity; of equal splits the first feature and limit win."""
    leaf = Tree(-1, verdict=bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.all() or not y.any():
        return leaf
    impurity = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
    best = (impurity(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            if min(low.sum(), (~low).sum()) >= least:
                cost = impurity(y[low]) + impurity(y[~low])
                if cost < best[0] - 1e-9:
                    best = (cost, f, float(limit))
    if best[1] is None:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


@lru_cache(1)
def trained() -> Tree:
    return grow(*labelled())


def kept_text(html: str | None, tree: Tree) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    return "\n\n".join(b.text for b, k in zip(found, tree.predict(features(found))) if k)


def main_text(html: str | None) -> str:
    """Main text of one page."""
    return kept_text(html, trained())


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``."""
    tree = trained()  # on the driver, from the table above

    def run(batches):
        for batch in batches:
            texts = [kept_text(h.as_py(), tree) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
