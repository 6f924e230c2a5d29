"""Main-text extraction from HTML by tree scoring.

A page becomes a tree of elements. What is never main text goes first: by element (menus, footers,
forms, scripts), by role, by classes and ids that say nothing but that (adverts, notices, sidebars, reader comments).
Every block with text of its own then passes points for its length and commas to its ancestors, the
whole to its parent and a share to those above, discounted by the density of links, and by half where a class or id has a word of what
surrounds main text among others; the best
container and those of its siblings that look like it are kept, and their blocks are joined.

Defined results: a null or empty page, or one without text, gives an empty text; broken markup is
read as far as it makes sense, an unclosed tag at the end is dropped; of containers with equal points the outermost counts; repeated rows get equal
results; pages of any length and depth take time in proportion to their length; columns of the input that are called text or n_chars are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*+)>"
    r"|</?[A-Za-z][^>]*\Z",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")

#: Elements of HTML by what they mean here; fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
RAW_END = {tag: re.compile(rf"</{tag}\s*/?>", re.IGNORECASE) for tag in RAW}
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never main text.
DROPPED = frozenset(
    "head script style noscript template svg math canvas object embed applet iframe nav footer aside form fieldset button select "
    "option textarea input label dialog menu audio video map xmp noembed noframes title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words in class or id that mark what surrounds main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr "
    "notice notices notification disclaimer popup modal overlay sidebar side rail aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies discussion share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login search widget widgets skip tags outbrain taboola hidden".split()
)
#: Words that mark main text, and words beside them that say nothing. An element with a class or id of such words alone isn't dropped for another class.
MAIN = frozenset("article articlebody main content post entry story body text".split())
NEUTRAL = frozenset("wrapper wrap container inner outer area page column col single full".split())
#: Words that beside MARKS only say where or what kind of piece: related-posts, ad-slot.
PIECES = frozenset("slot unit block box bar list item items section links link top bottom left right module region holder panel zone title head heading form button icon posts articles stories news thread threads count feed".split())
#: What the points of a block are worth that has a word of MARKS among others, and the density of links from which such a block isn't kept.
DISCOUNT, DISCOUNT_LINKS = 0.5, 0.33
#: The least share of an article's text that a container in it must have for the article to be kept whole.
MOST_OF_IT = 0.5
#: A class that starts so tells about something else: with-sidebar, has-comments.
ABOUT_OTHERS = frozenset("with has no without non".split())
#: Opening one of these closes an open element of the set behind it, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol menu dl table select div article section main aside body html blockquote td th form".split())
#: A block counts in a ul or ol of at least three items as a menu if so much of its text is links.
MENU_LINKS = 0.9


class Node:
    __slots__ = ("children", "doubtful", "dropped", "hints", "links", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, hints: frozenset = frozenset(), dropped: bool = False, doubtful: bool = False) -> None:
        self.tag, self.parent, self.hints, self.dropped, self.doubtful = tag, parent, hints, dropped, doubtful
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.links = 0


def _marked(tag: str, attrs: str, inside_main: bool) -> tuple[bool, bool, frozenset]:
    """Whether an element is dropped for its name, role, class or id, whether it is doubtful, and which words of main text it has."""
    if tag in DROPPED or tag == "header" and not inside_main:
        return True, False, frozenset()
    if not attrs or attrs.isspace():
        return False, False, frozenset()
    hints: set[str] = set()
    marks: set[str] = set()
    doubtful = False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id"):
            # camelCase and any other character part words.
            for word in value.split():
                found = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", word).lower())
                if not found or found[0] in ABOUT_OTHERS:
                    continue
                if own := MARKS.intersection(found):
                    if (MARKS | MAIN | NEUTRAL | PIECES).issuperset(found):
                        marks |= own
                    else:
                        doubtful = True
                if not MAIN.isdisjoint(found) and (MAIN | NEUTRAL).issuperset(found):
                    hints.update(MAIN.intersection(found))
        elif name == "role":
            if value.lower() in ROLES:
                return True, False, frozenset()
            if value.lower() in ("main", "article"):
                hints.add("main")
        elif name == "itemprop" and value.lower() == "articlebody":
            hints.add("articlebody")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return True, False, frozenset()
    if marks == {"header"} and inside_main:
        return False, doubtful, frozenset(["header"])
    return bool(marks) and not hints and tag not in ("body", "html", "article", "main"), doubtful, frozenset(hints)


class _Open:
    """The open elements, and where in their row those of each name are, so that no tag has to search for its partner."""

    def __init__(self, root: Node) -> None:
        self.row = [root]
        #: How many blocks are open up to each.
        self.blocks = [0]
        self.at: dict[str, list[int]] = {}
        self.names = ["#root"]

    @property
    def top(self) -> Node:
        return self.row[-1]

    def last(self, tags) -> int:
        """Where the innermost open element of these names is; 0, the root, if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_after(self, place: int, tags) -> int | None:
        """Where the outermost open element of these names behind a place is."""
        found = [self.at[t][k] for t in tags if self.at.get(t) and (k := bisect_right(self.at[t], place)) < len(self.at[t])]
        return min(found, default=None)

    def push(self, tag: str, node: Node) -> None:
        self.at.setdefault(tag, []).append(len(self.row))
        self.blocks.append(self.blocks[-1] + (tag in BLOCKS))
        self.row.append(node)
        self.names.append(tag)

    def close(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.row) > place:
            self.row.pop()
            self.blocks.pop()
            self.at[self.names.pop()].pop()


def parse(html: str) -> Node:
    root = Node("#root", None)
    open_ = _Open(root)
    place, n = 0, len(html)
    while place < n:
        lt = html.find("<", place)
        if lt < 0:
            lt = n
        if lt > place:
            open_.top.children.append(html[place:lt])
            place = lt
            continue
        m = TOKEN.match(html, lt)
        if not m:
            open_.top.children.append("<")
            place = lt + 1
            continue
        place = m.end()
        if m.group().startswith("<![CDATA["):
            open_.top.children.append(m.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            found = open_.last((tag,))
            # An inline element's end doesn't close a block that was opened inside it.
            if found and (tag in BLOCKS or open_.blocks[-1] == open_.blocks[found]):
                open_.close(found)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag == "br" or tag == "hr":
            open_.top.children.append(Node(tag, open_.top))
            continue
        # A block can't stand in a paragraph, nor an item in an item of the same list.
        if tag in BLOCKS and (p := open_.last(("p",))) > open_.last(HOLDERS):
            open_.close(p)
        if tag in HEADINGS and open_.top.tag in HEADINGS:
            open_.close(len(open_.row) - 1)
        if tag in CLOSES and (item := open_.first_after(open_.last(HOLDERS - CLOSES[tag]), CLOSES[tag])) is not None:
            open_.close(item)
        dropped, doubtful, hints = _marked(tag, attrs, open_.last(("article", "main")) > 0)
        # What is called a header inside main text is one.
        node = Node("header", open_.top) if hints == {"header"} else Node(tag, open_.top, hints, dropped, doubtful)
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(html, place)
            place = end.end() if end else n
            continue
        open_.top.children.append(node)
        open_.push(tag, node)
    return root


def _clean(text: str) -> str:
    return " ".join((unescape(text) if "&" in text else text).split())


#: Ancestors that would get less than this share of a block's points get none.
LEAST_SHARE = 0.01


def score(root: Node) -> list[Node]:
    """Points, text sizes and link sizes of all nodes that aren't dropped; returns the containers."""
    # Parents before children, so that the way back meets all of a node's children first.
    order, k = [root], 0
    while k < len(order):
        order += (c for c in order[k].children if isinstance(c, Node) and not c.dropped)
        k += 1
    # Length and commas of the text in a node's inline elements, at any depth.
    own: dict[int, tuple[int, int]] = {}
    for node in reversed(order):
        texts = [c for c in node.children if isinstance(c, str)]
        node.size += sum(len(t) - t.count(" ") - t.count("\n") for t in texts)
        if node.tag == "a":
            node.links = node.size
        if node.tag in ("ul", "ol", "table") and node.links >= MENU_LINKS * node.size > 0 and sum(isinstance(c, Node) for c in node.children) >= 3:
            node.dropped = True
            continue
        parent = node.parent
        if parent is not None:
            parent.size += node.size
            parent.links += node.links
        length, commas = own.pop(id(node), (0, 0))
        length, commas = length + sum(map(len, texts)), commas + sum(t.count(",") for t in texts)
        if node.tag not in BLOCKS and parent is not None:
            a, b = own.get(id(parent), (0, 0))
            own[id(parent)] = (a + length, b + commas)
            continue
        if length and node.size and node.tag not in HEADINGS:
            points = (1 + commas + min(length / 100, 3)) * (1 - min(1.0, node.links / max(1, node.size))) * (DISCOUNT if node.doubtful else 1)
            # The text of a container itself counts for it, that of a paragraph for what holds it.
            up = node if node.tag in ("article", "main", "section", "body", "div", "#root", "td") else parent
            share = 1.0
            while up is not None and share >= LEAST_SHARE:
                up.points += points * share
                up, share = up.parent, share / 2
    return [x for x in order if x.tag in BLOCKS and x.tag not in HEADINGS and x.tag != "p" or x.tag == "#root"]


def _value(node: Node) -> float:
    weight = 1.5 if node.tag in ("article", "main") or node.hints else 1.0
    return node.points * weight * (1 - node.links / max(1, node.size))


def _blocks(node: Node, out: list[str]) -> None:
    """Append the texts of node's blocks to out; an explicit stack, for pages can nest without end."""
    inline: list[str] = []

    def cut() -> None:
        if inline:
            if text := _clean("".join(inline)):
                out.append(text)
            inline.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            cut()
        elif isinstance(x, str):
            inline.append(x)
        elif x.dropped or x.doubtful and x.links > DISCOUNT_LINKS * x.size:
            continue
        elif x.tag == "br":
            inline.append(" ")
        elif x.tag == "header":
            # Inside main text a header's headings belong to it, the rest is about it.
            cut()
            heads, rest = [], deque(x.children)
            while rest:
                c = rest.popleft()
                if isinstance(c, Node) and not c.dropped:
                    if c.tag in HEADINGS:
                        heads.append(c)
                    else:
                        rest.extendleft(reversed(c.children))
            stack += reversed(heads)
        else:
            block = x.tag in BLOCKS
            if block:
                cut()
                stack.append(None)
            stack += reversed(x.children)
    cut()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    containers = score(root)
    best = max(containers, key=_value)  # of equals the outermost, which comes first
    if best.points <= 0:
        # No paragraph anywhere: what is left of the page, or an article that is all headings.
        best = next((x for x in containers if x.tag in ("article", "main")), root)
    else:
        x = best
        while x is not None and x.tag not in ("article", "main"):
            x = x.parent
        # An article is kept with its title and all, if the best container is most of it.
        if x is not None and best.size >= MOST_OF_IT * x.size:
            best = x
    out: list[str] = []
    siblings = best.parent.children if best.parent is not None else [best]
    least = max(10.0, 0.2 * best.points)
    for x in siblings:
        if x is best:
            _blocks(x, out)
        elif isinstance(x, Node) and not x.dropped and x.tag in BLOCKS:
            density = x.links / max(1, x.size)
            beside = x.tag == best.tag == "article" and x.points > 0
            if (beside or _value(x) >= least) and density < 0.5 or x.tag == "p" and best.tag not in ("article", "main") and (x.size > 80 and density < 0.25):
                _blocks(x, out)
    return "\n".join(out)


def extract(pages: DataFrame, *, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """The columns of pages but the html, with text and n_chars, its code points."""

    def made(texts: list) -> dict[str, list]:
        found = [main_text(x) for x in texts]
        return {"text": found, "n_chars": pa.array(list(map(len, found)), pa.int64())}

    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    return map_texts(pages.select(*kept), id_column, html_column, made, "text string, n_chars bigint")
