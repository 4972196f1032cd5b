"""Main text of web pages by a tree-structured graphical model.

Every block and every run of text of a page is a node that is content or not. Features of a
node (its tag, words in its class and id, length, links, punctuation) give it a potential, and
a table of potentials connects each node with its parent. Messages go from the leaves to the
root and back (sum-product, exact on a tree) and give each node's marginal; text runs whose
marginal is over one half are the article.

The weights are learned by maximum likelihood, whose gradient is the difference between labels
and marginals, from labelled pages. No labelled pages are among the tables, so they are made
here: pages of many shapes, in which each part is written as article or as something else.

Defined cases: null and empty pages give the empty text; broken or cut markup is read as far
as it goes; pages of any length are read whole; equal rows give equal texts; an empty table
gives no rows; other columns are passed through.
"""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trailspark.llm.batches import map_rows
from trailspark.llm.dom import Node, parse

#: Words in class, id and role that tell what a block is for.
HINTS = {
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar toc tabs".split(),
    "frame": "header masthead banner footer foot bottom copyright colophon logo branding".split(),
    "side": "sidebar aside side rail widget related recommended recommendations trending popular more tags "
    "share social follow author-bio meta".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy subscribe newsletter "
    "paywall signup message".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad adsense".split(),
    "form": "form login search contact signin input".split(),
    "comments": "comment comments reply replies discussion disqus respond reader-comments responses".split(),
    "content": "content article post entry story main text body prose article-body post-body maincontent".split(),
}
_HINT_OF = {word: kind for kind, words in HINTS.items() for word in words}
_TAG_KINDS = {
    "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form",
    "article": "article", "main": "article", "p": "paragraph", "pre": "paragraph", "blockquote": "paragraph",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "li": "item", "dt": "item", "dd": "item",
    "table": "table", "tr": "table", "td": "cell", "th": "cell", "dialog": "aside", "address": "footer",
    "#text": "text", "#root": "root", "body": "root", "html": "root",
}


def _features(nodes: list[Node], texts: list[str]) -> list[dict[str, float]]:
    links = [0] * len(nodes)
    sizes = [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        sizes[k] += len(texts[k])
        links[k] += min(nodes[k].linked, len(texts[k]))
        sizes[nodes[k].parent] += sizes[k]
        links[nodes[k].parent] += links[k]
    out = []
    for k, node in enumerate(nodes):
        f = {"bias": 1.0, "tag " + _TAG_KINDS.get(node.tag, "block"): 1.0}
        if node.names:
            words = set(re.findall(r"[a-z]+", node.names)) | set(re.split(r"[\s_]+", node.names))
            for word in words:
                if word in _HINT_OF:
                    f["hint " + _HINT_OF[word]] = 1.0
        if node.tag == "#text":
            text = texts[k]
            words = text.count(" ") + 1
            f["of " + _TAG_KINDS.get(nodes[node.parent].tag, "block")] = 1.0
            f["length"] = min(math.log1p(words), 6.0) / 3
            f["sentence"] = float(text[-1:] in ".!?…:”\"")
            f["short"] = float(words < 4)
            f["links"] = links[k] / max(1, len(text))
            f["copyright"] = float("©" in text)
        else:
            f["linked"] = links[k] / max(1, sizes[k])
        out.append(f)
    return out


class TreeModel:
    """Weights of features for `content`, and log potentials [parent][child]."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.edges = [[0.0, 0.0], [0.0, 0.0]]

    def marginals(self, parents: list[int], features: list[dict[str, float]]):
        """(marginal of each node being content, marginals [parent][child] of each edge)."""
        n, weights = len(parents), self.weights
        psi = [[math.exp(x) for x in row] for row in self.edges]
        unary = []
        for f in features:
            s = sum(weights.get(name, 0.0) * value for name, value in f.items())
            s = max(-30.0, min(30.0, s))
            unary.append((1.0, math.exp(s)))
        up = [list(u) for u in unary]  # a node's potential with all messages from below
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            a, b = up[k]
            total = a + b
            a, b = a / total, b / total
            up[k] = [a, b]
            m0, m1 = psi[0][0] * a + psi[0][1] * b, psi[1][0] * a + psi[1][1] * b
            s = m0 + m1
            sent[k] = (m0 / s, m1 / s)
            above = up[parents[k]]
            above[0] *= sent[k][0]
            above[1] *= sent[k][1]
            if above[0] + above[1] < 1e-200:
                above[0] *= 1e200
                above[1] *= 1e200
        belief = [(0.0, 0.0)] * n
        total = up[0][0] + up[0][1]
        belief[0] = (up[0][0] / total, up[0][1] / total)
        pairs: list[tuple] = [()] * n
        for k in range(1, n):
            p, (a, b) = belief[parents[k]], up[k]
            c0, c1 = p[0] / max(sent[k][0], 1e-300), p[1] / max(sent[k][1], 1e-300)
            q = (c0 * psi[0][0] * a, c0 * psi[0][1] * b, c1 * psi[1][0] * a, c1 * psi[1][1] * b)
            total = sum(q) or 1.0
            q = tuple(x / total for x in q)
            pairs[k] = q
            belief[k] = (q[0] + q[2], q[1] + q[3])
        return [b[1] for b in belief], pairs

    def learn(self, pages: list[tuple[list[int], list[dict], list[int]]], rounds: int = 60) -> None:
        """Gradient ascent on the likelihood of the labels, with a small penalty on size."""
        squares: dict = {}
        for _ in range(rounds):
            gradient: dict = {}
            for parents, features, labels in pages:
                belief, pairs = self.marginals(parents, features)
                for f, y, p in zip(features, labels, belief):
                    for name, value in f.items():
                        gradient[name] = gradient.get(name, 0.0) + (y - p) * value
                for k in range(1, len(parents)):
                    for e in range(4):
                        seen = (labels[parents[k]], labels[k]) == divmod(e, 2)
                        gradient[e] = gradient.get(e, 0.0) + seen - pairs[k][e]
            for name, g in gradient.items():
                old = self.edges[name // 2][name % 2] if isinstance(name, int) else self.weights.get(name, 0.0)
                g = g / len(pages) - 0.002 * old
                squares[name] = squares.get(name, 1e-8) + g * g
                new = old + 0.5 * g / math.sqrt(squares[name])
                if isinstance(name, int):
                    self.edges[name // 2][name % 2] = new
                else:
                    self.weights[name] = new


def labels_of(nodes: list[Node]) -> list[int]:
    """1 for text runs under a block marked `data-y="1"`, and for blocks that hold such a run."""
    marks, labels = [""] * len(nodes), [0] * len(nodes)
    for k, node in enumerate(nodes):
        marks[k] = node.mark or (marks[node.parent] if k else "")
        labels[k] = int(node.tag == "#text" and marks[k] == "1")
    for k in range(len(nodes) - 1, 0, -1):
        labels[nodes[k].parent] |= labels[k]
    return labels


def made_pages(count: int = 240, seed: int = 5) -> list[str]:
    """Labelled pages: `data-y` says of each part whether it is the article."""
    rnd = random.Random(seed)
    syllables = "ba de li mo ru sta ten vor ing er an os ti ón ge ver che".split()

    def word() -> str:
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))

    def prose(low: int, high: int, stop: str = ".") -> str:
        return " ".join(word() for _ in range(rnd.randint(low, high))).capitalize() + stop

    def linked(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{prose(1, 4, "")}</a></{tag}>' for _ in range(n))

    def hinted(kind: str) -> str:
        return f'{rnd.choice(("class", "id"))}="{rnd.choice(HINTS[kind])}"'

    def other() -> str:
        """A block that is not the article."""
        kind = rnd.randrange(12)
        if kind == 0:
            return f"<nav><ul>{linked(rnd.randint(3, 8))}</ul></nav>"
        if kind == 1:
            return f'<div {hinted("navigation")}>{linked(rnd.randint(2, 6), rnd.choice(("span", "div", "li")))}</div>'
        if kind == 2:
            return f'<header {rnd.choice(("", hinted("frame")))}><h1>{prose(1, 3, "")}</h1><p>{prose(2, 8)}</p></header>'
        if kind == 3:
            return f'<footer>&copy; {prose(1, 4, "")} &middot; {prose(3, 12)}</footer>'
        if kind == 4:
            return f'<div {hinted("frame")}><p>{prose(3, 14)}</p></div>'
        if kind == 5:
            return f'<aside {rnd.choice(("", hinted("side")))}><h3>{prose(1, 3, "")}</h3><p>{prose(5, 40)}</p><ul>{linked(3)}</ul></aside>'
        if kind == 6:
            return f'<div {hinted("side")}><h3>{prose(1, 3, "")}</h3>{rnd.choice((f"<ul>{linked(4)}</ul>", f"<p>{prose(5, 40)}</p>"))}</div>'
        if kind == 7:
            return f'<div {hinted("notice")}>{rnd.choice((prose(6, 30), f"<p>{prose(6, 30)}</p>"))}<button>ok</button></div>'
        if kind == 8:
            return f'<div {hinted("advert")}>{rnd.choice((prose(4, 25), f"<p>{prose(4, 25)}</p>"))}</div>'
        if kind == 9:
            return f'<form action="/s"><label>{prose(1, 4, "")}</label><p>{prose(3, 12)}</p><input></form>'
        if kind == 10:
            return f'<section {hinted("comments")}><h2>{prose(1, 2, "")}</h2>' + "".join(
                f"<div {rnd.choice(('', hinted('comments')))}><b>{word()}</b><p>{prose(5, 60)}</p></div>" for _ in range(rnd.randint(1, 4))
            ) + "</section>"
        return f"<ul>{linked(rnd.randint(3, 9))}</ul>"

    def block() -> str:
        kind = rnd.randrange(12)
        if kind == 0:
            return f"<h2>{prose(1, 6, '')}</h2>"
        if kind == 1:
            return "<ul>" + "".join(f"<li>{prose(1, 20, rnd.choice(('.', '')))}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>"
        if kind == 2:
            return f"<blockquote><p>{prose(5, 30)}</p></blockquote>"
        if kind == 3:
            rows = "".join(f"<tr><td>{prose(1, 4, '')}</td><td>{prose(1, 4, '')}</td></tr>" for _ in range(rnd.randint(1, 4)))
            return f"<table>{rows}</table>"
        if kind == 4:
            return f"<pre>{prose(4, 20)}</pre>"
        text = " ".join(prose(1, 20) for _ in range(rnd.randint(1, 6)))
        if rnd.random() < 0.25:
            text = prose(1, 3)
        if rnd.random() < 0.3:
            text += f' <a href="/y">{prose(1, 3, "")}</a> {prose(3, 9)}'
        return f"<p>{text}</p>"

    pages = []
    for _ in range(count):
        blocks = [block() for _ in range(rnd.randint(1, 14))]
        if rnd.random() < 0.8:
            blocks.insert(0, f"<h1>{prose(2, 10, '')}</h1>")
        for _ in range(rnd.choice((0, 0, 1, 2))):
            blocks.insert(rnd.randint(1, len(blocks)), f'<div data-y="0">{other()}</div>')
        inner = "".join(blocks)
        shell = rnd.randrange(5)
        if shell < 2:
            article = f'<article data-y="1">{inner}</article>'
        elif shell == 2:
            article = f'<main data-y="1"><div>{inner}</div></main>'
        else:
            article = f'<div data-y="1" {hinted("content") if shell == 3 else ""}>{inner}</div>'
        before = "".join(other() for _ in range(rnd.randint(0, 4)))
        after = "".join(other() for _ in range(rnd.randint(0, 4)))
        page = before + article + after
        if rnd.random() < 0.5:
            page = f"<div>{page}</div>"
        pages.append(f'<html><head><title>{word()}</title></head><body data-y="0">{page}</body></html>')
    return pages


def train(pages: list[str] | None = None) -> TreeModel:
    """Learn from labelled pages (`made_pages` unless others are given); a fixed, small sample."""
    examples = []
    for page in pages or made_pages():
        nodes = parse(page)
        texts = [n.text for n in nodes]
        examples.append(([n.parent for n in nodes], _features(nodes, texts), labels_of(nodes)))
    model = TreeModel()
    model.learn(examples)
    return model


def extract(model: TreeModel, page: str | None) -> str:
    if not page:
        return ""
    nodes = parse(page)
    texts = [n.text for n in nodes]
    marginals, _ = model.marginals([n.parent for n in nodes], _features(nodes, texts))
    return "\n".join(t for n, t, p in zip(nodes, texts, marginals) if n.tag == "#text" and t and p > 0.5)


def extract_pages(pages: DataFrame, html: str = "html", model: TreeModel | None = None) -> DataFrame:
    """Replace the page's markup by `text` and `n_chars`; trains a model unless one is given."""
    model = model or train()
    added = StructType([StructField("text", StringType(), False), StructField("n_chars", LongType(), False)])

    def make():
        def run(values):
            texts = [extract(model, v) for v in values]
            return [(t, len(t)) for t in texts]

        return run

    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    return map_rows(pages, keep, [html], added, make)
