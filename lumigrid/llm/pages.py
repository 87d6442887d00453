"""Pages as trees: a lenient reader of HTML that keeps block structure, blocks of text and what marks a block as not the article.

Structure holds block elements only; inline elements belong to their block's text. Paragraphs, lists, tables and the like are leaves
of the structure (``FLOW``), and siblings of one shape are one node, so a page's skeleton says how it is built and not how long it is.
A skeleton is text, ``label(child,child)``; its nodes are numbered in order of appearance. Levels below ``DEEPEST`` belong to the node above.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

#: Levels of structure that are told apart; text below them stays.
DEEPEST = 48

#: Elements by their part in a page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure address details hr center hgroup".split())
INSIDE = frozenset("li dt dd thead tbody tfoot tr td th caption figcaption summary legend".split())
HOLDERS = frozenset("html body div section article main header footer nav aside form fieldset dialog menu search noscript template".split())
BLOCKS = FLOW | INSIDE | HOLDERS
NEVER = frozenset("head script style textarea title xmp iframe noembed noframes noscript template object embed svg canvas audio video map nav footer aside menu search dialog form fieldset button select datalist label input".split())
CLOSES_P = (FLOW | HOLDERS) - {"noscript", "template", "html", "body"}
#: Starting one of these ends an open one of the second list, unless one of the third lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words in classes and ids that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar share sharing social related recommended recommendations "
    "comment comments commentlist disqus replies respond footer header masthead topbar copyright search form skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Words beside which ``header`` names an article's own heading.
OWN = frozenset("article post entry story content".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>?""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_LOOKED_AT = re.compile(r"(?i)\b(?:class|id|role|hidden|style|aria-hidden)\b")
_WORDS = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@lru_cache(1 << 14)
def _attributes(raw: str) -> tuple[str, frozenset[str], bool]:
    """Of a start tag: its class and id as a label, their words, whether it says that it isn't the article by other means."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw[: raw.rfind(">")] if raw.endswith(">") else raw, _NAME.match(raw).end()):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")).lower())
    words = _WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}")
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(_UNSEEN.search(found.get("style", "")))
    return "-".join(words), frozenset(words), hidden or found.get("role") in ROLES


class Node:
    __slots__ = ("label", "parent", "children", "shape", "number")

    def __init__(self, label: str, parent: Node | None):
        self.label, self.parent, self.children = label, parent, []
        if parent is not None:
            parent.children.append(self)


class Page:
    """``blocks``: (node, text, characters inside links) in page order, without what is marked; ``skeleton``; numbers of nodes in it."""

    def __init__(self, source: str):
        self._read(source, False)
        # a mark around everything, or around the article, marks nothing
        if "<" in source and (not self.blocks or self.buried and not self.explicit):
            kept = self.blocks, self.nodes, self.explicit, self.buried
            self._read(source, True)
            if not self.blocks:
                self.blocks, self.nodes, self.explicit, self.buried = kept
        self._number()

    def _read(self, source: str, lenient: bool) -> None:
        root = Node("page", None)
        self.nodes, self.blocks = [root], []
        #: Whether an article or main element was met; whether one was met inside something marked.
        self.explicit = self.buried = False
        stack: list[tuple[str, Node, bool]] = [("", root, False)]
        count: Counter[str] = Counter()  # of open elements
        pieces: list[str] = []
        links = 0

        def flush() -> None:
            nonlocal links
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((stack[-1][1], text, links))
                pieces.clear()
            links = 0

        def say(text: str) -> None:
            nonlocal links
            if not stack[-1][2]:
                text = html.unescape(text) if "&" in text else text
                pieces.append(text)
                if count["a"]:
                    links += len(text)

        def close(to: int) -> None:
            gone = [e[0] for e in stack[to:]]
            if not BLOCKS.isdisjoint(gone):
                flush()
            count.subtract(gone)
            del stack[to:]

        def opened(names: tuple[str, ...], barriers: tuple[str, ...]) -> int:
            """The outermost open one of ``names`` above the innermost barrier, or 0."""
            at, left = 0, sum(count[n] for n in names)
            for i in range(len(stack) - 1, 0, -1):
                if not left:
                    break
                if stack[i][0] in names:
                    at, left = i, left - 1
                elif stack[i][0] in barriers:
                    break
            return at

        def mark(tag: str, words: frozenset[str], told: bool) -> bool:
            if tag in ("html", "body"):
                return False
            if tag in NEVER:
                return not (lenient and tag in ("form", "fieldset"))
            if told:
                return True
            if tag in ("article", "main"):
                return bool(words & COMMENTS)
            own = bool(count["article"] or count["main"])
            if tag == "header":
                return not own
            return not lenient and bool(words & MARKS) and not ("header" in words and (own or words & OWN) and not words & (MARKS - {"header"}))

        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                say(source[at:])
                break
            if m.start() > at:
                say(source[at : m.start()])
            raw, at = m[0], m.end()
            if raw[1] in "!?":
                continue
            tag = _NAME.match(raw)[1].lower()
            if raw[1] == "/":
                block = tag in BLOCKS
                for i in range(len(stack) - 1, 0, -1) if count[tag] else ():
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if not block and stack[i][0] in BLOCKS or tag in INSIDE and stack[i][0] in ("table", "ul", "ol", "dl") and stack[i][0] != tag:
                        break
                continue
            if tag in CLOSES_P and (i := opened(("p",), ("td", "th", "caption", "table", "button", "object"))):
                close(i)
            if tag in ENDS and (i := opened(*ENDS[tag])):
                close(i)
            if tag in ("br", "wbr"):
                if tag == "br":
                    say(" ")
                continue
            if tag in BLOCKS and tag not in ("noscript", "template") and (i := opened(("head",), ())):
                close(i)
            if tag in ("html", "body") and opened((tag,), ()):
                continue
            label, words, told = _attributes(raw) if _LOOKED_AT.search(raw) else ("", frozenset(), False)
            parent = stack[-1]
            away = parent[2] or mark(tag, words, told)
            if tag in ("article", "main"):
                self.explicit |= not away
                self.buried |= away
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else size
                stack.append((tag, parent[1], True))
                count[tag] += 1
                continue
            node = parent[1]
            if tag in BLOCKS:
                flush()
                if not parent[2] and node.label.partition(".")[0].rstrip("!") not in FLOW and tag not in INSIDE and len(stack) <= DEEPEST:
                    node = Node(tag + (f".{label}" if label and tag not in ("html", "body") else "") + "!" * away, node)
                    self.nodes.append(node)
            stack.append((tag, node, away))
            count[tag] += 1
        flush()

    def _number(self) -> None:
        for n in reversed(self.nodes):  # children come after their parents
            shapes = list(dict.fromkeys(c.shape for c in n.children))
            n.shape = f"{n.label}({','.join(shapes)})" if shapes else n.label
        self.skeleton = self.nodes[0].shape
        places = _short(self.skeleton) if len(self.skeleton) < 2_000 else numbers(self.skeleton)
        self.nodes[0].number = 0
        for n in self.nodes[1:]:
            n.number = places[n.parent.number, n.shape]
        self.size = len(places) + 1


def numbers(skeleton: str) -> dict[tuple[int, str], int]:
    """Numbers of nodes by their parent's number and their own shape."""
    out: dict[tuple[int, str], int] = {}
    open_: list[tuple[int, int]] = [(0, 0)]  # (number, where its shape begins)
    taken = 1

    def shut(end: int) -> None:
        n, start = open_.pop()
        if open_:
            out[open_[-1][0], skeleton[start:end]] = n

    for m in re.finditer(r"[(,)]", skeleton):
        if m[0] != "(":
            shut(m.start())
        if m[0] != ")":
            open_.append((taken, m.end()))
            taken += 1
    return out


_short = lru_cache(1024)(numbers)
