"""HTML extraction by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by length, stop-word density and link
density, inside a marked article as well as outside; the second gives ambiguous short blocks the label of the nearest
decided neighbours. Elements that are menus, headers, footers, sidebars, forms and the like by their tag or role are
left out. A class or id is a vote only: it counts by whole words, and is overruled where the container holds the
article or most of the page's prose.
"""

import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of

#: Frequent function words of English, French, German and Spanish. (fixed values)
STOP_WORDS = frozenset(
    """
    a about an and are as at be been but by for from had has have he her his i in is it its not of on or our she that
    the their they this to was we were which will with you
    au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais ne nous on ou par pas pour qu que
    qui sa se ses son sur un une vous
    aber als am auch auf aus bei das dass dem den der die durch ein eine einen er es für hat ich im ist mit nach nicht
    noch nur oder sich sie sind so über um und von vor war wie wir zu zum zur
    al como con del el ella entre era esta este ha hay las lo los más muy no o para pero por sin sobre su sus también
    todo y ya
    """.split()
)

#: Elements whose content is never text of the article; elements whose content is not markup. (fixed values)
_OUTSIDE = frozenset("nav footer aside form menu dialog button select option svg object canvas audio video template fieldset".split())
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table
    tbody td tfoot th thead tr ul""".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Whole words in a class or id that vote for something other than the article. (fixed values)
_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adbox adslot alert banner breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies copyright disclaimer disqus feedback footer gdpr legal login masthead menu menus mainmenu submenu modal nav
    navbar navigation navlinks navmenu mainnav sidenav subnav topnav newsletter notice notification pager pagination popup promo promos
    promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored
    sponsors subscribe subscription teaser teasers toolbar widget widgets""".split()
)
#: First words of a class that tell a state, a look or a topic, and do not name the element (has-sidebar, tag-search). (fixed values)
_ABOUT = frozenset("has is no not with without js bg text color tag category cat topic format".split())
#: Names that tell where an element stands, and not what it says: wrappers of the article bear them as well. (fixed values)
_LAYOUT = frozenset(
    """banner header menu menus mainmenu submenu nav navbar navigation navlinks navmenu mainnav sidenav subnav topnav pager pagination promo
    related search share sharing sidebar sidebars social teaser teasers toolbar topbar widget widgets""".split()
)
#: Names of reader comments. (fixed values)
_COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
#: A class or id that names the article itself.
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|story)(?:$|\s)|(?:article|story|entry|post)[_-]?(?:body|content|text)(?:$|[\s])", re.I)
#: A heading that is a title of reader comments and nothing else: the word, with a number before or after it.
_COMMENT_HEAD = re.compile(
    r"(?:\(?\d[\d.,\s]*\)?\s*)?(?:(?:leave|post|add|write) a |(?:reader|user|all) )?"
    r"(?:comments?|replies|reply|responses?|kommentare?|commentaires?|comentarios?)\s*:?\s*(?:\(?\d[\d.,\s]*\)?)?\s*:?",
    re.I,
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words of a short block; link share, stop-word shares and words that decide a block.
SHORT, LINKED = 10, 0.35
FEW_STOPS, MANY_STOPS, LONG = 0.05, 0.15, 25

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/=>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_READ = frozenset("class id role hidden aria-hidden style".split())
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")  # the page ends inside a tag
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = (".", "!", "?", "…", ":")
_LETTERS = re.compile(r"[^\W\d_]+")


class Container:
    """An element that is named as something other than the article, in the innermost other one around it."""

    __slots__ = ("name", "above", "comments", "words", "article", "shut")

    def __init__(self, name: str, above: "Container | None") -> None:
        self.name, self.above, self.shut = name, above, True
        self.comments = name in _COMMENT_NAMES or bool(above and above.comments)
        self.words = self.article = 0  # words, links and comments aside, and those of them in an article


class Element:
    """An open element: whether it is excluded, in an article, or after a comment title, here or above, and the
    innermost named container."""

    __slots__ = ("tag", "outside", "inside", "over", "named")

    def __init__(self, tag: str, outside: bool, inside: bool, over: bool, named: Container | None) -> None:
        self.tag, self.outside, self.inside, self.over, self.named = tag, outside, inside, over, named


class Block:
    __slots__ = ("parts", "linked", "outside", "inside", "heading", "over", "parent", "named", "label", "text")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.outside = self.inside = self.heading = self.over = False
        self.parent: Element | None = None  # of a heading: the element it stands in
        self.named: Container | None = None
        self.label: bool | None = None
        self.text = ""


def _attributes(raw: str) -> dict[str, str]:
    """The attributes that count, by lower-case name; of repeated ones the first. Values are read whole, so nothing inside one is a name."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        if (name := name.lower()) in _READ:
            found.setdefault(name, value.strip("\"'"))
    return found


def _excluded(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in _OUTSIDE or (tag == "header" and not in_article):
        return True
    for name, value in attributes.items():
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _named(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """The word of the class or id that votes for something other than the article, or nothing. Words are whole:
    parts between hyphens, underscores and capitals. An article is only ever named as a comment, by a class that
    begins so."""
    if tag in ("html", "body", "main"):
        return ""
    for name in ("class", "id"):
        for token in attributes.get(name, "").split():
            words = [x.lower() for x in _NAME.findall(token)]
            if not words or words[0] in _ABOUT:
                continue
            for low in words[:1] if tag == "article" else words:
                if low in _COMMENT_NAMES or (tag != "article" and (low in _NAMES or (low in ("header", "topbar") and not in_article))):
                    return low
    return ""


def _is_article(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("article", "main"):
        return True
    if tag not in ("div", "section", "td"):
        return False
    return any(_ARTICLE.search(attributes.get(n, "")) for n in ("class", "id"))


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Every tag is read once; unclosed and stray tags are tolerated."""
    out: list[Block] = []
    page_element = Element("", False, False, False, None)
    stack = [page_element]
    now, links, at = Block(), 0, 0

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            now.parts.append(piece)
            if links:
                now.linked += len(piece.strip())

    def close() -> None:
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            out.append(now)
            if now.parent and not now.outside and _COMMENT_HEAD.fullmatch(now.text):
                now.over = now.parent.over = True  # up to the end of the heading's container
        now, top = Block(), stack[-1]
        now.outside, now.inside, now.over, now.named = top.outside, top.inside, top.over, top.named
        now.heading = top.tag in _HEADINGS
        if now.heading:
            now.parent = stack[-2]

    while (m := _TAG.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), None)
            if depth is not None:
                own, above = stack[depth], stack[depth - 1]
                changes = (own.outside, own.inside, own.named) != (above.outside, above.inside, above.named)
                del stack[depth:]
                if tag in _BLOCK or changes:
                    close()
            elif tag in _BLOCK:
                close()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            now.parts.append(" ")
        if tag in _VOID:
            if tag == "hr":
                close()
            continue
        if tag in ("p", "li", "dd", "dt", "tr", "td", "option") and stack[-1].tag == tag:
            stack.pop()
        elif tag in _BLOCK and tag != "p":
            while stack[-1].tag == "p":
                stack.pop()
        if tag in ("article", "main") and stack[-1].tag in ("nav", "header"):
            stack.pop()  # never closed
        above = stack[-1]
        attributes = _attributes(m[3]) if m[3] else {}
        inside = above.inside or _is_article(tag, attributes)
        excluded = above.outside or _excluded(tag, attributes, inside)
        name = _named(tag, attributes, inside) if attributes and not excluded else ""
        named = Container(name, above.named) if name else above.named
        changes = (excluded, inside, named) != (above.outside, above.inside, above.named)
        stack.append(Element(tag, excluded, inside, above.over, named))
        if tag == "a":
            links += 1
        if tag in _BLOCK or changes:
            close()
    text(_CUT_TAG.sub("", page[at:]))
    close()
    return out


def free(found: list[Block]) -> None:
    """Decides the votes of names: a container named as something else is outside, unless it holds the page's article,
    or it is named by a word of layout and, on a page without an article, over half of the prose (words of blocks that
    have few links) stands in it. Reader comments are outside in any case."""
    named: dict[Container, None] = {}  # from the outside in
    total = 0
    for b in found:
        chain, c = [], b.named
        while c and c not in named:
            chain.append(c)
            c = c.above
        named.update(dict.fromkeys(reversed(chain)))
        if b.outside or b.linked > LINKED * len(b.text) or (b.named and b.named.comments):
            continue
        n = len(b.text.split())
        total += n
        if b.named:
            b.named.words += n
            b.named.article += n if b.inside else 0
    for c in reversed(named):
        if c.above:
            c.above.words += c.words
            c.above.article += c.article
    elsewhere = any(b.inside and not b.outside and not b.named for b in found)
    for c in named:
        holds = not elsewhere and not c.comments and 2 * c.words > total and (c.article > 0 or c.name in _LAYOUT)
        c.shut = not holds or bool(c.above and c.above.shut)
    for b in found:
        b.outside = b.outside or bool(b.named and b.named.shut)


def decide(found: list[Block]) -> None:
    """First pass: sets label to True (article), False or None (ambiguous) by each block's own features. Inside a
    marked article the same densities decide, but few stop words leave a block ambiguous instead of out."""
    marked = any(b.inside and not b.outside for b in found)
    for b in found:
        if b.outside or (marked and not b.inside) or (b.over and not (marked and b.inside)) or b.linked > LINKED * len(b.text):
            b.label = False
            continue
        words = _LETTERS.findall(b.text.lower())
        n = len(b.text.split())
        inside = marked and b.inside
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if n < LONG and "©" in b.text and not inside:
            b.label = False
        elif n <= SHORT or b.heading or not words:
            b.label = None
        elif stops >= MANY_STOPS and n >= LONG:
            b.label = True
        elif stops < FEW_STOPS and not inside:
            b.label = False
        # else shorter prose, or some stop words in a block of any length: ambiguous


def settle(found: list[Block]) -> None:
    """Second pass: an ambiguous block takes the label of the nearest decided block on each side in its section, which
    is what stands between two headings; where these differ, a block that reads as a sentence is text, and others
    follow the one fewer words away. A heading takes the label of what follows. Without a decided neighbour in the
    section, the nearest ones beyond count alike. Neighbours across the article's edge say nothing, and neither do
    menus in the article. On a side of the edge without text, ambiguous blocks are text."""
    n = len(found)
    size = [len(b.text.split()) for b in found]
    some = {side: any(b.label for b in found if b.inside == side) for side in (False, True)}

    def nearest(order: Iterable[int], sections: bool) -> list[tuple[bool, int] | None]:
        out: list[tuple[bool, int] | None] = [None] * n
        last, side = None, None
        for k in order:
            b = found[k]
            if b.inside != side:
                last, side = None, b.inside
            out[k] = last
            if b.heading and sections and not b.outside:
                last = None
            elif b.label is not None and not (b.inside and b.outside):
                last = b.label, 0
            elif last:
                last = last[0], last[1] + size[k]
        return out

    sides = {s: (nearest(range(n), s), nearest(range(n - 1, -1, -1), s)) for s in (True, False)}
    for k, b in [(k, b) for k, b in enumerate(found) if b.label is None]:
        x, y = sides[not b.heading][0][k], sides[not b.heading][1][k]
        if x is None and y is None:
            x, y = sides[False][0][k], sides[False][1][k]
        if not some[b.inside]:
            b.label = True
        elif x is None or y is None:
            b.label = (x or y or (True, 0))[0]
        elif x[0] == y[0] or b.heading:
            b.label = y[0]
        else:
            b.label = b.text.endswith(_ENDS) or (x if x[1] <= y[1] else y)[0]


def main_text(page: str) -> str:
    found = blocks(page)
    free(found)
    decide(found)
    settle(found)
    return " ".join(b.text for b in found if b.label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without an article, have an empty text. Blocks are decoded, their white space
    is made one space, and they are joined by one space in page order. Rows are independent: repeated rows, null
    ids and other columns change nothing, and there is no shuffle.
    """

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extracted(text_of(F.col(html_col))).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
