"""HTML extraction by two-pass block rules.

A tolerant scanner cuts a page into blocks: runs of text between block-level tags, with character references decoded, white space
as one space, and the share of characters in links. Markup that never holds text (scripts, styles, hidden elements) is left out while scanning.

Pass one scores each block. Stop-word density and length count for it, link density against it; a long block without stop words counts
against it, a short one is undecided. Structure is evidence beside that: elements such as menus, footers, side columns, forms, and those whose class, id or
role names such a thing, weigh heavily against what they hold, unless next to nothing of the page's text is outside them, so that they are a mere
wrapper; and where ``article`` or ``main`` elements hold at least half of the page's prose, blocks inside gain and blocks outside lose a point. Blocks
with points are ``good``, those below zero ``bad``, the others ``ambiguous``.

Pass two: an ambiguous block inherits the label of its nearest decided neighbours
above and below; where they differ, that of the one in the same element, else a heading takes the label below it, and other blocks that of the
one that is apart or in an article as they are, else of the nearer. A page without any good block keeps its ambiguous blocks that have no links (those in an article, if any are).

Languages. Stop words are listed for eight languages. A page that hardly has any of them, or is in a script without gaps between words, is judged by sentence marks
in place of stop words.

Defined results: null and empty html give an empty text; text without any tag is one block; unclosed elements end with their
parent, unclosed comments, scripts and styles with the page; scanning takes time in proportion to the page, however deep or unclosed
its elements are; equal pages give equal texts; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.session import bounded_batches

# Elements by how HTML treats them.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "noframes", "title", "textarea", "select", "canvas", "audio", "video", "head", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "rp", "rt",
}
APART = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "toolbar", "dialog", "alertdialog", "alert"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HOLDERS = {"article", "main", "section", "div", "td", "body", "blockquote", "ul", "ol"}
BOUNDS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "td", "aside", "nav", "footer", "form"}
#: What an element's start closes, beside an open paragraph.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words that name a part beside the text, and words that say nothing about a part. A class or id names such a part if it is made of both kinds and has one of the first.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification notifications popup modal overlay sidebar sidebars side aside "
    "widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share shares sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "search comment comments commentlist disqus replies reply respond discussion pager pagination copyright legal disclaimer tags tag meta skip".split()
)
NEUTRAL = set("site page top left right bottom upper lower box bar list wrapper wrap container section area block item items inner outer primary secondary post article entry global local main mobile desktop link links form buttons button".split())
STOP = {
    "en": "the of and to a in is it that for was on are as with be by at this from or an have not which you but his her they we were has had their its one all there been if more will would can who no about",
    "de": "der die und das ist in zu den mit von für auf ein eine nicht sich des dem im es an auch als am aus bei nach wird war sind hat wie noch nur oder aber wenn durch man über einen einer eines zum zur",
    "fr": "le la les de des du et en un une est que qui dans pour pas sur au aux avec ce se son sa ses il elle ne par plus sont mais ou on nous vous leur cette comme tout été être ont fait",
    "es": "el la los las de del y en un una es que no se por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos",
    "it": "il lo la i gli le di a da in con su per tra fra un uno una e è che non si del della dei delle nel nella al alla come più ma se anche sono ha hanno questo questa",
    "pt": "o a os as de do da dos das em no na nos nas um uma e é que não se por para com como mais mas foi ao ele ela seu sua ou quando muito também já são tem",
    "nl": "de het een en van in op te dat die is voor met zijn aan niet er om ook als bij door over uit naar maar dan nog wel heeft had werd worden deze dit of",
    "pl": "w i na z do się nie że to jest o jak po co tak za od przez ale dla czy już są był była było oraz ich jego jej ten ta które który która tym tego",
}
STOP_WORDS = frozenset(w for words in STOP.values() for w in words.split())

#: Characters under which a block is short, and from which it is long; shares of link characters and of stop words; shares of the page.
TINY, SHORT, LONG = 25, 70, 200
LINKS_BAD, ARTICLE_LINKS, STOPS_LOW, STOPS_HIGH, UNLISTED = 0.33, 0.5, 0.10, 0.20, 0.08
WRAPPER_REST, ARTICLE_SHARE = 0.1, 0.5

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]{0,4000}\"|'[^']{0,4000}')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_RIGHTS = re.compile(r"(©|\(c\)|copyright\b)", re.I)
_MARKS = re.compile(r"[.!?…,;。！？、，；।؟،]")
#: Scripts written without gaps between words.
_GAPLESS = re.compile("[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


@dataclass
class Block:
    text: str
    links: float
    article: bool
    heading: bool
    holder: int
    #: The innermost element that is apart, 0 for none.
    mark: int = 0
    label: str = "ambiguous"


@dataclass
class _Open:
    """An open block element, with what it has from its parents."""

    name: str
    number: int
    article: bool = False
    heading: bool = False
    holder: int = 0
    mark: int = 0


def names_apart(attribute: str) -> bool:
    """Does a class or id say that the element is beside the text?"""
    for token in attribute.lower().split():
        parts = [x for x in re.split(r"[-_\d]+", token) if x]
        if any(x in NAMES for x in parts) and all(x in NAMES or x in NEUTRAL for x in parts):
            return True
    return False


@dataclass
class _Scan:
    """The scanner's state: open block elements, how many there are of each name, the open link, hidden inline text, and the block being read."""

    stack: list[_Open] = field(default_factory=lambda: [_Open("", 0)])
    count: Counter = field(default_factory=Counter)
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    opened: int = 0
    #: The element around each element that is apart.
    above: list[int] = field(default_factory=lambda: [0])
    link: int = 0
    hidden: tuple[str, int] | None = None
    nested: int = 0
    skipped: int = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(p for p, _ in self.parts)).strip()
        if text:
            linked = len(_SPACE.sub(" ", "".join(p for p, a in self.parts if a)).strip())
            top = self.stack[-1]
            self.blocks.append(Block(text, linked / len(text), top.article, top.heading, top.holder, top.mark))
        self.parts = []

    def _cut(self, size: int) -> None:
        """Closes elements down to ``size`` open ones."""
        for o in self.stack[size:]:
            self.count[o.name] -= 1
        del self.stack[size:]
        self.link = self.link if self.link <= size else 0
        if self.hidden and self.hidden[1] > size:
            self.hidden = None
        if self.skipped > size:
            self.skipped = 0

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append((" ", False))
            return
        inline = name in INLINE
        if not inline:
            self.flush()
            closes = CLOSES.get(name, set()) | {"p"}
            if any(self.count[c] for c in closes):
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i].name in closes:
                        self._cut(i)
                        break
                    if self.stack[i].name in BOUNDS:
                        break
        if name in VOID:
            return
        found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
        if inline:
            if name == "a":
                self.link = len(self.stack)
            if self.hidden and self.hidden[0] == name:
                self.nested += 1
            elif unseen and not self.hidden:
                self.hidden, self.nested = (name, len(self.stack)), 1
            return
        up, role = self.stack[-1], found.get("role", "").lower()
        self.opened += 1
        apart = name in APART or role in ROLES or (name not in ("body", "html", "article", "main") and (names_apart(found.get("class", "")) or names_apart(found.get("id", "")))) or (name == "header" and not up.article)
        mark = up.mark
        if apart:
            self.above.append(up.mark)
            mark = len(self.above) - 1
        self.stack.append(_Open(name, self.opened, up.article or name in ("article", "main") or role in ("main", "article"), up.heading or name in HEADINGS, self.opened if name in HOLDERS else up.holder, mark))
        self.count[name] += 1
        if unseen and not self.skipped:
            self.skipped = len(self.stack)

    def end(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self.link = 0
            if self.hidden and self.hidden[0] == name:
                self.nested -= 1
                self.hidden = self.hidden if self.nested else None
            return
        self.flush()
        if not self.count[name]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                self._cut(i)
                return
            # the end of a paragraph or list item does not close what holds it
            if name in ("p", "li") and self.stack[i].name not in ("p", "li"):
                return

    def text(self, raw: str) -> None:
        if raw and not self.hidden and not self.skipped:
            self.parts.append((unescape(raw), bool(self.link)))


def scan(html: str) -> _Scan:
    """The page's blocks in order."""
    state, at = _Scan(), 0
    while at < len(html):
        m = _TAG.search(html, at)
        if not m:
            break
        state.text(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            state.end(name)
        elif name in RAW:
            if name == "head":  # its children are raw or void, and its end may be missing
                continue
            body = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = body.end() if body else len(html)
        else:
            state.start(name, m[3] or m[6] or "")
    else:
        at = len(html)
    state.text(html[at:])
    state.flush()
    return state


def _stops(text: str) -> tuple[int, int]:
    """Stop words, and all words."""
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def fluency(found: list[Block]) -> list[int]:
    """How much each block reads like sentences, 0 to 2: by its stop words, or on a page without, by its sentence marks."""
    counts = [_stops(b.text) for b in found]
    plain = [c for c, b in zip(counts, found, strict=True) if b.links <= LINKS_BAD]
    stops, words = sum(c[0] for c in plain), sum(c[1] for c in plain)
    out = []
    for b, (s, n) in zip(found, counts, strict=True):
        gapless = len(_GAPLESS.findall(b.text))
        if words and stops >= UNLISTED * words and 2 * gapless < len(b.text):
            out.append(0 if not n or s < STOPS_LOW * n else 1 if s < STOPS_HIGH * n else 2)
        else:
            marks = len(_MARKS.findall(b.text))
            # a mark for every 25 words, or 60 characters where words have no gaps
            enough = marks and (60 * marks >= gapless if 2 * gapless >= len(b.text) else 25 * marks >= n)
            out.append(0 if not enough else 1 if marks < 2 else 2)
    return out


def content(b: Block, fluent: int) -> int:
    """Points for a block by itself: links, length, fluency."""
    if b.links > LINKS_BAD or _RIGHTS.match(b.text):
        return -2
    # characters of gapless scripts say more
    size = len(b.text) + 2 * len(_GAPLESS.findall(b.text))
    if b.heading or size < SHORT:
        return 0
    return fluent if size >= LONG and fluent else 1 if fluent else -1


def apart(found: list[Block], points: list[int], above: list[int]) -> list[bool]:
    """By mark: does it count? One that next to nothing is outside of is a wrapper, and does not."""
    prose, text = [0] * len(above), [0] * len(above)
    for b, p in zip(found, points, strict=True):
        if b.links <= LINKS_BAD:
            text[b.mark] += len(b.text)
            prose[b.mark] += len(b.text) * (p > 0)
    for k in range(len(above) - 1, 0, -1):
        prose[above[k]] += prose[k]
        text[above[k]] += text[k]
    out = [False]
    for k in range(1, len(above)):
        wrapper = prose[k] > 0 and text[0] - text[k] < WRAPPER_REST * prose[k]
        out.append(not wrapper or out[above[k]])
    return out


def classify(found: list[Block], above: list[int]) -> list[Block]:
    """Labels the blocks: pass one by evidence, pass two by neighbours."""
    points = [content(b, f) for b, f in zip(found, fluency(found), strict=True)]
    out = apart(found, points, above)
    near = [(b, p) for b, p in zip(found, points, strict=True) if not out[b.mark]]
    size = lambda rows: sum(len(b.text) for b in rows)
    prose = [b for b, p in near if p > 0] or [b for b, p in near if p == 0]
    in_article = bool(prose) and any(b.article for b in prose) and size(b for b in prose if b.article) >= ARTICLE_SHARE * size(prose)
    for b, p in zip(found, points, strict=True):
        if out[b.mark]:
            p -= 3
        elif in_article and b.article:
            # links are part of an article's text
            p = 0 if p == -2 and b.links <= ARTICLE_LINKS and not _RIGHTS.match(b.text) else p
            p += 0 if b.heading or len(b.text) < TINY else 1
        elif in_article:
            p -= 1
        b.label = "good" if p > 0 else "bad" if p < 0 else "ambiguous"
    if not any(b.label == "good" for b in found):
        some = [b for b in found if b.label == "ambiguous" and not b.links]
        for b in [b for b in some if b.article] or some:
            b.label = "good"
        return found
    decided, labels, k = [i for i, b in enumerate(found) if b.label != "ambiguous"], [b.label for b in found], 0
    for i, b in enumerate(found):
        while k < len(decided) and decided[k] < i:
            k += 1
        if b.label == "ambiguous":
            labels[i] = _inherit(found, i, decided[k - 1] if k else None, decided[k] if k < len(decided) else None)
    for b, label in zip(found, labels, strict=True):
        b.label = label
    return found


def _inherit(found: list[Block], i: int, above: int | None, below: int | None) -> str:
    if above is None or below is None:
        return found[below if above is None else above].label
    up, down = found[above], found[below]
    if up.label == down.label:
        return up.label
    mine = found[i]
    same = [n for n in (up, down) if n.holder == mine.holder and n.article == mine.article]
    if len(same) == 1:
        return same[0].label
    if mine.heading:
        return down.label
    # a part beside the text says less about a block that is not in it
    same = [n for n in (up, down) if n.mark == mine.mark and n.article == mine.article]
    if len(same) == 1:
        return same[0].label
    return up.label if i - above <= below - i else down.label


def main_text(html: str | None) -> str:
    """The good blocks, joined by an empty line."""
    page = scan(html or "")
    return "\n\n".join(b.text for b in classify(page.blocks, page.above) if b.label == "good")


def extract(html: Column) -> Column:
    """The main text of each page."""
    bounded_batches()

    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(p.as_py()) for p in pages), pa.string())

    return of(html)
