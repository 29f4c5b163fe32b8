"""Web pages as trees: elements with text, their texts, and the blocks that the texts form.

A small tolerant reader: tags that HTML closes by itself (paragraphs, list items, cells) are
closed, end tags that nothing opened are ignored, cut tags and comments at the end are dropped.
Nodes are numbered so that a parent comes before its children.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe textarea select button canvas svg object audio video title datalist math noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr legend li main menu nav ol p pre section summary table tbody thead tfoot tr caption ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = frozenset("br td th".split())
#: Opening one of the first closes an open one of the second, up to the nearest of the third.
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset({"dl"})),
    "dd": (frozenset("dt dd".split()), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset({"tr"})),
    "th": (frozenset("td th".split()), frozenset({"tr"})),
}
FRAME = frozenset("html head body".split())
WALLS = frozenset("table td th caption".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"\b(class|id|role|itemprop|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def name_parts(names: str) -> set[str]:
    """Words of class names and the like: ``sidebarLeft post-body`` has four."""
    return {p.lower() for p in PARTS.findall(names)}


@dataclass
class Tree:
    """Node 0 is the page.  ``text`` is None for elements; ``block`` numbers the block of a text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    names: list[str] = field(default_factory=lambda: [""])
    label: list[str] = field(default_factory=lambda: [""])
    text: list[str | None] = field(default_factory=lambda: [None])
    block: list[int] = field(default_factory=lambda: [-1])

    def add(self, parent: int, tag: str, names: str = "", label: str = "", text: str | None = None, block: int = -1) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.label.append(label)
        self.text.append(text)
        self.block.append(block)
        return len(self.parent) - 1


class _Open:
    """The open elements of a page."""

    def __init__(self):
        self.nodes, self.tags, self.count = [0], ["#page"], {}

    def push(self, node: int, tag: str) -> None:
        self.nodes.append(node)
        self.tags.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1

    def close(self, tags: frozenset[str], walls: frozenset[str]) -> bool:
        """Close the innermost open element among ``tags`` and all within it, unless one of ``walls`` lies between."""
        if not any(self.count.get(t) for t in tags):
            return False
        at = len(self.tags) - 1
        while at > 0 and self.tags[at] not in tags:
            if self.tags[at] in walls:
                return False
            at -= 1
        if at == 0:
            return False
        for tag in self.tags[at:]:
            self.count[tag] -= 1
        del self.nodes[at:], self.tags[at:]
        return True


def _attributes(rest: str) -> tuple[str, str]:
    names, label = [], ""
    for key, *values in NAMES.findall(rest):
        value = next(filter(None, values), "")
        if key.lower() == "data-label":
            label = value
        else:
            names.append(value)
    return " ".join(names), label


def read_page(page: str | None) -> Tree:
    """The tree of a page: elements, and a text node per stretch of one element's text in one block."""
    tree, open_, block, at, glued = Tree(), _Open(), 0, 0, False
    page = page or ""

    def say(text: str) -> None:
        nonlocal glued
        if "&" in text:
            text = html.unescape(text)
        if glued and tree.text[-1] is not None and tree.block[-1] == block and tree.parent[-1] == open_.nodes[-1]:
            tree.text[-1] += text
        else:
            tree.add(open_.nodes[-1], "#text", text=text, block=block)
            glued = True

    for found in MARKUP.finditer(page):
        if found.start() < at:
            continue
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag or tag in FRAME:
            continue
        if tag in SPACED:
            say(" ")
        if tag in BLOCKS:
            block += 1
        if found["end"]:
            if tag in BLOCKS or tag in WALLS:
                open_.close(frozenset({tag}), WALLS - {tag})
            else:
                open_.close(frozenset({tag}), BLOCKS | WALLS)
            glued = False
            continue
        if tag in UNSEEN:
            if not found["rest"].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            open_.close(frozenset({"p"}), WALLS)
        if tag in HEADINGS and open_.tags[-1] in HEADINGS:
            open_.close(HEADINGS, frozenset())
        if tag in CLOSES:
            open_.close(*CLOSES[tag])
        if tag not in VOID:
            node = tree.add(open_.nodes[-1], tag, *_attributes(found["rest"]))
            open_.push(node, tag)
            glued = False
    if at < len(page):
        say(page[at:])
    return tree
