"""A page as a tree of blocks: elements that start a block, and the runs of text between them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")

#: Elements by their part in the markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "script style title noscript template iframe svg math textarea select option object noembed noframes xmp".split()
)
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "html head body article main section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 "
    "ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "address details summary dialog menu hgroup center".split()
)
ENDS_PARAGRAPH = BLOCKS - {"html", "head", "body"}
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
}


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    mark: str = ""
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


def parse(page: str) -> list[Node]:
    """Nodes in page order; text runs have the tag `#text` and their block as parent."""
    nodes = [Node("#root", -1)]
    open_blocks = [0]
    run: int | None = None
    links = hidden = 0
    hidden_tag = ""
    at = 0

    def say(raw: str) -> None:
        nonlocal run
        if not raw or hidden:
            return
        if run is None:
            if not raw.strip():
                return
            run = len(nodes)
            nodes.append(Node("#text", open_blocks[-1]))
        text = html.unescape(raw) if "&" in raw else raw
        nodes[run].parts.append(text)
        if links:
            nodes[run].linked += len(text)

    def close(depth: int) -> None:
        nonlocal run
        del open_blocks[depth:]
        run = None

    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            say(page[at:])
            break
        say(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        ending = bool(tag[1] or tag[4])
        if hidden:
            if name == hidden_tag:
                hidden += -1 if ending else 1
            continue
        if ending:
            if name == "a":
                links = 0
            elif name in BLOCKS:
                depth = next((d for d in range(len(open_blocks) - 1, 0, -1) if nodes[open_blocks[d]].tag == name), 0)
                if depth:
                    close(depth)
            continue
        attributes = tag[3] or tag[6] or ""
        if name in UNSEEN:
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}", re.IGNORECASE).search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = stop + 1 if stop >= 0 else len(page)
            elif not attributes.rstrip().endswith("/"):
                hidden, hidden_tag = 1, name
            continue
        if name == "br":
            say(" ")
        elif name == "hr":
            run = None
        elif name == "a":
            links = 1
        if name not in BLOCKS:
            continue
        if name in ENDS_PARAGRAPH:
            depth = next((d for d in range(len(open_blocks) - 1, 0, -1) if nodes[open_blocks[d]].tag == "p"), 0)
            if depth:
                close(depth)
        if name in _SIBLINGS:
            same, within = _SIBLINGS[name]
            depth = 0
            for d in range(len(open_blocks) - 1, 0, -1):
                if nodes[open_blocks[d]].tag in within:
                    break
                if nodes[open_blocks[d]].tag in same:
                    depth = d
            if depth:
                close(depth)
        run, links = None, 0
        named = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        names = f"{named.get('class', '')} {named.get('id', '')} {named.get('role', '')}".strip().lower()
        nodes.append(Node(name, open_blocks[-1], names, named.get("data-y", "")))
        open_blocks.append(len(nodes) - 1)
    return nodes
