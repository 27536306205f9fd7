"""A page as a tree of elements, built the way browsers build one: ends that are implied, and formatting that is
closed in the wrong order."""

from __future__ import annotations

import re
from html import escape
from html.entities import html5
from html.parser import HTMLParser

#: Fixed values of the HTML standard: elements without content, formatting, those that end a paragraph, and those that
#: bound what an end tag inside them can close.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu"
    " nav ol p pre search section summary table ul".split()
)
BOUNDS = frozenset("table td th caption object template".split())
SPECIAL = ENDS_PARAGRAPH | BOUNDS | frozenset("li dd dt tr tbody thead tfoot body html head button select option script style iframe".split())
#: A start tag closes these open elements, looking up to the nearest of the others.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), **{t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Deeper elements stand beside their parent, so that work stays linear in the page and no recursion runs out.
DEEPEST = 250
#: Formatting elements that hold at a time.
MOST_HELD = 32


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("tag", "attrs", "parent", "children", "sums")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.parent, self.children, self.sums = tag, attrs, None, [], None

    def add(self, child: Node) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        child.parent = self
        self.children.append(child)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open: list[Node] = [self.root]
        #: Formatting elements that still hold, None where a table cell or the like begins.
        self.active: list[Node | None] = []
        self.count = 0

    # --- what the parser calls

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named: dict[str, str] = {}
        for name, value in attrs:
            named.setdefault(name, value or "")
        if tag in ("html", "body", "head"):
            return
        if tag in ENDS_PARAGRAPH:
            self._close_one({"p"}, BOUNDS | {"button"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop(self.open[-1])
        if tag in IMPLIED:
            self._close_one(*IMPLIED[tag])
        if tag == "a" and any(x is not None and x.tag == "a" for x in self._holding()):
            self._adopt("a")
        if tag not in SPECIAL:
            self._reopen()
        node = self._insert(Node(tag, named))
        if tag in VOID:
            self.open.pop()
        elif tag in FORMATTING:
            self._hold(node)
        elif tag in BOUNDS:
            self.active.append(None)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in FORMATTING:
            self._adopt(tag)
        elif tag == "br":
            self.handle_starttag("br", [])
        elif tag not in ("html", "body", "head"):
            self._close_one(HEADINGS if tag in HEADINGS else {tag}, set() if tag in BOUNDS else BOUNDS)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._reopen()
        at = self.open[-1].children
        if at and isinstance(at[-1], str):
            at[-1] += data
        else:
            at.append(data)

    # --- the stack

    def _insert(self, node: Node) -> Node:
        self.count += 1
        if len(self.open) > DEEPEST:
            self.open.pop()
        self.open[-1].add(node)
        self.open.append(node)
        return node

    def _close_one(self, tags: set[str] | frozenset[str], up_to: set[str] | frozenset[str]) -> None:
        for node in reversed(self.open[1:]):
            if node.tag in tags:
                self._pop(node)
                return
            if node.tag in up_to:
                return

    def _pop(self, node: Node) -> None:
        """Closes the open elements down to node."""
        while True:
            last = self.open.pop()
            if last.tag in BOUNDS:
                while self.active and self.active.pop() is not None:
                    pass
            if last is node:
                return

    def _holding(self) -> list[Node]:
        out = []
        for node in reversed(self.active):
            if node is None:
                break
            out.append(node)
        return out

    def _hold(self, node: Node) -> None:
        """At most three alike hold at a time, and at most MOST_HELD in all, so that unclosed ones don't pile up."""
        holding = self._holding()
        alike = [x for x in holding if x.tag == node.tag and x.attrs == node.attrs]
        for old in {id(x): x for x in (alike[2:] + holding[MOST_HELD - 1 :])}.values():
            self.active.remove(old)
        self.active.append(node)

    def _reopen(self) -> None:
        """Formatting that still holds but was closed with what stood around it starts again."""
        closed = []
        for node in self._holding():
            if node in self.open:
                break
            closed.append(node)
        for node in reversed(closed):
            again = self._insert(Node(node.tag, node.attrs))
            self.active[self.active.index(node)] = again

    def _adopt(self, tag: str) -> None:
        """The end of a formatting element that others, or a block, were opened in: a block leaves it and takes a copy
        of it for the content it has so far."""
        for _ in range(8):
            own = next((x for x in self._holding() if x.tag == tag), None)
            if own is None:
                self._close_one({tag}, SPECIAL)
                return
            if own not in self.open:
                self.active.remove(own)
                return
            at = self.open.index(own)
            block = next((k for k in range(at + 1, len(self.open)) if self.open[k].tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.active.remove(own)
                return
            furthest, last, place = self.open[block], self.open[block], self.active.index(own)
            for k in range(block - 1, at, -1):
                node = self.open[k]
                if node not in self.active:
                    del self.open[k]
                    continue
                again = Node(node.tag, node.attrs)
                self.active[self.active.index(node)] = self.open[k] = again
                again.add(last)
                last = again
            self.open[at - 1].add(last)
            again = Node(own.tag, own.attrs)
            for child in list(furthest.children):
                if isinstance(child, Node):
                    child.parent = again
                again.children.append(child)
            furthest.children = []
            furthest.add(again)
            self.open.remove(own)
            self.open.insert(self.open.index(furthest) + 1, again)
            self.active[place] = again


#: An ampersand, and the reference that it begins if a semicolon ends it; those that pages are full of are passed over.
_REFERENCE = re.compile("&(?!(?:amp|lt|gt|quot|#x27);)(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")


def ended_references(markup: str) -> str:
    """Markup in which only references that a semicolon ends are references; any other ampersand stands for itself.
    (Browsers read some names without one too, such as &amp in a text that was cut.)"""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[0][1:]}", markup)


def parse(markup: str) -> tuple[Node, int]:
    """The page's root, whose children are what its body and head hold, and how many elements there are."""
    builder = Builder()
    builder.feed(markup)
    builder.close()
    return builder.root, builder.count


def serialised(node: Node | str) -> str:
    """Markup of a tree; text in script and style stays as it is."""
    out: list[str] = []
    _serialise(node, out)
    return "".join(out)


def _serialise(node: Node | str, out: list[str], raw: bool = False) -> None:
    if isinstance(node, str):
        out.append(node if raw else escape(node, quote=False))
        return
    if node.tag:
        out.append(f"<{node.tag}{''.join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())}>")
    if node.tag in VOID:
        return
    for child in node.children:
        _serialise(child, out, node.tag in ("script", "style"))
    if node.tag:
        out.append(f"</{node.tag}>")
