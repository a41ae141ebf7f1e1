"""Main text of web pages by scoring the element tree.

A page is read once into a tree of elements and a list of text blocks. Every block passes points for
its length and its commas to its ancestors, less the farther they are, and discounted by the share of
its text that is links. The element with the most points, after its own link share, is the main
container; siblings that score enough are kept with it. Scripts, menus, notices and the like never
score and are never part of the text. What only a class, id or role marks as such is judged when the
whole page is read: it stays if it holds the page's article or main element or most of its text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches

# Elements whose content is never article text.
_UNSEEN = frozenset("script style noscript template head title svg math canvas iframe object embed audio video map "
                    "button select option textarea datalist dialog".split())
_APART = frozenset("nav footer aside menu fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
                    "ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements that hold one paragraph: their points begin at the parent.
_LEAVES = frozenset("p li pre td th dd dt blockquote figcaption caption h1 h2 h3 h4 h5 h6 summary legend address".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
# A start tag of the key ends an open element of the values, unless one of the limits lies between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
         "option": ({"option"}, {"select"})}

# Words in class, id or role that mark an element as no part of the article.
_MARKS = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notice\w*|alert\w*|"
    r"popup|modal|overlay|side-?bar\w*|aside|widget\w*|related|recommend\w*|comments?|commentlist|respond|disqus|replies|"
    r"nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|pager|footer\w*|copyright|masthead|site-?header|topbar|"
    r"share|sharing|social\w*|newsletter\w*|subscribe\w*|subscription|signup|login|register|search|toolbar|skip|"
    r"complementary|contentinfo|dialog|tags|taglist)(?=$|[\s_-])", re.I)
# Names that tell how a page is laid out or what state it is in, whatever marks they contain.
_LAYOUT = re.compile(
    r"(?:.*[_-])?(?:has|no|not|with|without|hide|show)[_-].*|elementor-.*|.*[_-](?:accepted|declined|enabled|disabled)|"
    r"(?:.*[_-])?(?:content|main|page|site)[_-](?:.*[_-])?(?:wrap|wrapper|container|layout)", re.I)
# Marks of parts that hold articles or long texts other than the page's own.
_COMMENTS = frozenset(("comme", "respo", "disqu", "repli"))
_FOREIGN = _COMMENTS | {"promo", "spons", "ad", "ads", "adver", "adsen", "adslo"}
_OTHERS = _FOREIGN | {"relat", "recom"}
_HEADER_MARKS = re.compile(r"(?:^|[\s_-])(?:page-?header|header)(?:$|[\s_-])", re.I)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|content|entry|post|story|text|body|main)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MAIN = ("article", "main")
_COMMAS = re.compile(r"[,،、，﹐﹑]")
_SPACE = re.compile(r"\s+")

MOST = 0.5              # marked elements with more than this share of the unlinked text are not left out
MARKED_SHARE = 0.5      # of the points of a block in such an element
SIBLING_SHARE = 0.2     # a sibling with this share of the best score is kept
LINK_LIST = 0.8         # a list with this share of link text is a menu
CHARS_PER_POINT = 100
MOST_LENGTH_POINTS = 3
CONTENT_POINTS = 5      # for scoring elements that are named as content
LEVELS = 64             # ancestors that each block's points are passed to one by one; beyond, all points pass in one go


class _Element:
    __slots__ = ("tag", "parent", "apart", "main", "named", "marks", "own", "share", "score", "chars", "links", "unlinked", "passed")

    def __init__(self, tag: str, parent: "_Element | None", apart: bool = False, main: bool = False,
                 named: bool = False, marks: frozenset[str] = frozenset(), own: str = "") -> None:
        self.tag, self.parent, self.apart, self.main, self.named = tag, parent, apart, main, named
        self.marks, self.own = marks, own  # kinds of its marks; "main" or "article" if it is one itself
        self.share = 1.0  # of a block's points
        self.score, self.chars, self.links, self.unlinked = 0.0, 0, 0, 0
        self.passed = 0.0  # points on their way to ancestors beyond LEVELS

    def link_share(self) -> float:
        return self.links / self.chars if self.chars else 0.0


class _Page(HTMLParser):
    """Reads a page into elements, in page order, and blocks (owner, [(element, data, is linked)])."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [_Element("#page", None)]
        self.open = list(self.elements)
        self.blocks: list[tuple[_Element, list[tuple[_Element, str, bool]]]] = []
        self.parts: list[tuple[_Element, str, bool]] = []
        self.links = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        block = tag in _BLOCKS
        if block:
            self.end_block()
            self._make_room(tag)
        elif tag == "a":
            self._end({"a"}, _BLOCKS)
        elif tag == "br":
            self.parts.append((self.open[-1], " ", False))
        if tag in _VOID:
            return
        above, given = self.open[-1], dict(attrs)
        names = " ".join(filter(None, (given.get("class"), given.get("role"))))
        marks = " ".join(filter(None, (names, given.get("id"))))
        main = tag in ("article", "main") or given.get("role") in ("main", "article") or given.get("itemprop") == "articleBody"
        apart = above.apart or _left_out(tag, given, above)
        own = "" if not main else "article" if tag == "article" or given.get("role") == "article" else "main"
        element = _Element(tag, above, apart, above.main or main, main or bool(block and _CONTENT.search(marks)),
                           frozenset() if apart else _marks(tag, names, given.get("id") or "", above), own)
        self.elements.append(element)
        self.open.append(element)
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # "/" before ">" closes void elements only

    def handle_endtag(self, tag: str) -> None:
        if tag in _HEADINGS:
            self.end_block()
            self._end(_HEADINGS, _TABLE_PARTS)
        elif tag in _BLOCKS:
            self.end_block()
            self._end({tag}, frozenset() if tag in _TABLE_PARTS or tag in ("body", "html", "article", "main") else _TABLE_PARTS)
        elif not self._end({tag}, _BLOCKS) and tag == "a" and self.links:
            for element in reversed(self.open):  # the link goes on in blocks opened within it
                if element.tag == "a":
                    element.tag = "#ended"
                    self.links -= 1
                    break

    def handle_data(self, data: str) -> None:
        if not self.open[-1].apart:
            self.parts.append((self.open[-1], data, self.links > 0))

    def _make_room(self, tag: str) -> None:
        """End what a block's start tag ends without an end tag."""
        self._end({"head"}, frozenset())
        if tag not in ("html", "body"):
            self._end({"p"}, _BLOCKS - {"p"})
        if tag in _HEADINGS and self.open[-1].tag in _HEADINGS:
            self._close(len(self.open) - 1)
        if tag in _ENDS:
            ended, limits = _ENDS[tag]
            while self._end(ended, limits):
                pass

    def _end(self, tags, limits) -> bool:
        """Close the nearest open element of ``tags``, unless one of ``limits`` lies above it."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                self._close(at)
                return True
            if self.open[at].tag in limits:
                return False
        return False

    def _close(self, at: int) -> None:
        self.links -= sum(element.tag == "a" for element in self.open[at:])
        del self.open[at:]

    def end_block(self) -> None:
        if not self.parts:
            return
        owner = self.open[-1]
        while owner.parent is not None and owner.tag not in _BLOCKS:
            owner = owner.parent
        self.blocks.append((owner, self.parts))
        self.parts = []

    def texts(self) -> list[tuple[_Element, str, int]]:
        """Blocks (owner, text, characters in links) without what is left out."""
        self._judge()
        out = []
        for owner, parts in self.blocks:
            parts = [part for part in parts if not part[0].apart]
            text = _SPACE.sub(" ", "".join(data for _, data, _ in parts)).strip()
            if text:
                linked = len(_SPACE.sub(" ", "".join(data for _, data, link in parts if link)).strip())
                out.append((owner, text, min(linked, len(text))))
        return out

    def _judge(self) -> None:
        """Leave out marked elements, but for those that hold the article or most of the unlinked text."""
        if not any(element.marks for element in self.elements):
            return
        for _, parts in self.blocks:
            for element, data, link in parts:
                if not link:
                    element.unlinked += len("".join(data.split()))
        for element in reversed(self.elements):
            if element.parent is not None:
                element.parent.unlinked += element.unlinked
        # kinds of marks above and at each element; what each kind's outermost elements hold
        within: dict[int, frozenset[str]] = {}
        held: dict[str, int] = {}
        comments = 0
        longest: dict[str, _Element] = {}
        for element in self.elements:
            above = frozenset() if element.parent is None else within[id(element.parent)]
            new = element.marks - above
            within[id(element)] = above | new if new else above
            for kind in new:
                held[kind] = held.get(kind, 0) + element.unlinked
            if new & _COMMENTS and not above & _COMMENTS:
                comments += element.unlinked
            if element.own and element.unlinked and not within[id(element)] & _OTHERS:
                if element.own not in longest or element.unlinked > longest[element.own].unlinked:
                    longest[element.own] = element
        holders = set()
        for element in longest.values():
            while element is not None:
                holders.add(id(element))
                element = element.parent
        # comments may be longer than what they are about
        least = MOST * (self.elements[0].unlinked - comments)
        most = {kind for kind, n in held.items() if n > least} - _COMMENTS

        def leave_out(most) -> list[bool]:
            left_out: dict[int, bool] = {}
            for element in self.elements:
                above = element.parent is not None and left_out[id(element.parent)]
                left_out[id(element)] = (above or element.apart
                                         or bool(element.marks - most) and id(element) not in holders)
            return [left_out[id(element)] for element in self.elements]

        apart = leave_out(most)
        gone = {id(element) for element, out in zip(self.elements, apart) if out}
        if not any(data.strip() and id(element) not in gone for _, parts in self.blocks for element, data, _ in parts):
            # nothing but marked text: better that than none
            most = set(held)
            apart = leave_out(most)
        for element, out in zip(self.elements, apart):
            element.apart = out
            marked = bool(element.marks) and id(element) not in holders
            element.share = MARKED_SHARE if marked else 1.0 if element.parent is None else element.parent.share


def _left_out(tag: str, given: dict, above: _Element) -> bool:
    return (tag in _UNSEEN or tag in _APART or (tag == "header" and not above.main) or "hidden" in given
            or (given.get("aria-hidden") or "").lower() == "true" or bool(_HIDDEN.search(given.get("style") or "")))


def _marks(tag: str, names: str, own_id: str, above: _Element) -> frozenset[str]:
    """Kinds of the marks of an element: the beginnings of the words that match, so there are few.

    Within the article an id is mostly made from a heading. There it marks comments and adverts only, but for
    a ``div`` that is no section of its own, and on a heading nothing; headings and paragraphs are marked as
    comments and adverts only.
    """
    if not above.main or tag == "div" and "section" not in names.split():
        return _kinds(tag, f"{names} {own_id}".strip(), above)
    kinds = _kinds(tag, names, above)
    if tag in _HEADINGS or tag == "p":
        return kinds & _FOREIGN
    return kinds | (_kinds("", own_id, above) & _FOREIGN)


def _kinds(tag: str, names: str, above: _Element) -> frozenset[str]:
    kinds = {"form"} if tag == "form" else set()
    if names and tag not in ("html", "body", "article", "main") and (_MARKS.search(names) or _HEADER_MARKS.search(names)):
        for name in names.split():
            if not _LAYOUT.fullmatch(name):
                kinds.update(word[:5].lower() for word in _MARKS.findall(name))
                if not above.main and _HEADER_MARKS.search(name):
                    kinds.add("header")
    return frozenset(kinds)


def _container(page: _Page, blocks: list[tuple[_Element, str, int]]) -> set[int]:
    """Identities of the elements whose blocks are the article."""
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.links += linked
        if owner.tag in _HEADINGS:
            continue
        points = 1 + len(_COMMAS.findall(text)) + min(len(text) / CHARS_PER_POINT, MOST_LENGTH_POINTS)
        points *= (1 - linked / len(text)) * owner.share
        to = owner.parent if owner.tag in _LEAVES and owner.parent is not None else owner
        for level in range(LEVELS):
            if to is None:
                break
            to.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            to = to.parent
        if to is not None:
            to.passed += points / (3 * LEVELS)
    for element in reversed(page.elements):  # children come after their parents
        element.score += element.passed
        if element.parent is not None:
            element.parent.passed += element.passed * LEVELS / (LEVELS + 1)
            element.parent.chars += element.chars
            element.parent.links += element.links
    best, most = None, 0.0
    for element in page.elements:
        if element.score > 0:
            element.score = (element.score + CONTENT_POINTS * element.named * element.share) * (1 - element.link_share())
            if element.score > most:  # the first in page order of equals
                best, most = element, element.score
    if best is None:
        named = next((e for e in page.elements if e.tag in _MAIN and e.chars), page.elements[0])
        return {id(named)}
    for wanted in _MAIN:
        at = best
        while at is not None and at.tag != wanted:
            at = at.parent
        if at is not None:
            return {id(at)}
    kept, before = {id(best)}, None
    for element in page.elements:
        if element.parent is not best.parent or element is best or element.apart or element.share < best.share:
            if element is best and before is not None:
                kept.add(id(before))  # the heading right above the container
            continue
        if element.score >= SIBLING_SHARE * most or (element.tag == "p" and element.chars > 80 and element.link_share() < 0.25):
            kept.add(id(element))
        before = element if element.tag in _HEADINGS else None
    return kept


def main_text(html: str | None) -> str:
    """The article of a page as blocks joined by two line feeds; empty if there is none.

    White space inside a block, also of line breaks and preformatted text, becomes one space.
    """
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page.end_block()
    blocks = page.texts()
    if not blocks:
        return ""
    kept = _container(page, blocks)
    chosen: dict[int, bool] = {}
    for element in page.elements:
        menu = element.tag in ("ul", "ol", "menu", "dir") and element.chars > 0 and element.link_share() >= LINK_LIST
        above = element.parent is not None and chosen[id(element.parent)]
        chosen[id(element)] = (above or id(element) in kept) and not menu
    return "\n\n".join(text for owner, text, _ in blocks if chosen[id(owner)])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars`` (code points).

    A null or empty page, and one without any text, gives an empty string. Malformed pages give what
    their open and unclosed elements hold. Repeated rows give repeated results; other columns are
    not read. Pages are extracted where they are read, without a shuffle.
    """
    bound_batches(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts],
                                             names=["page_id", "url", "text"])

    return (pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
            .mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
            .withColumn("n_chars", F.length("text").cast("long")))
