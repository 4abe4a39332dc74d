"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: its block elements, and the runs of text inside them as leaves. Every node is content or not.
Parent-child potentials P(child | parent, child's tag group) connect the nodes, and each node's features (tag group, words
of class, id and role, length and link share of a text) are evidence. Sum-product messages go up and down the tree;
texts whose marginal is at least 1/2 are the page's main text. Potentials are counted on labelled pages, which
``labelled_pages`` composes from a fixed seed (menus, headers, adverts, notices, side bars, forms, comments, footers and
articles, nested in many ways); nothing is downloaded.

Scripts, styles, titles, templates and form controls hold no text. A block is the text between two borders of block
elements, or up to ``hr``; ``br`` is white space. Very long pages are taken whole; a marginal of just 1/2 counts as content. Character references are decoded, white space becomes one space, blocks are trimmed, empty
ones vanish, and the rest is joined by one line feed. Null html is empty: text "" and 0 characters. Rows that repeat are
extracted row by row; other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import lean_batches

#: Element names by what they do to text.
RAW = {"script", "style", "title", "textarea", "template", "select", "option", "button"}
WHOLE = {"html", "head", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup",
    "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "legend", *HEADINGS,
}
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"ul", "ol", "menu", "table", "dl", "html", "body"}
GOOD_WORDS = {"article", "content", "post", "entry", "main", "story", "body", "text", "prose"}
BAD_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "sponsor", "sponsored", "promo", "banner", "nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "footer", "header", "masthead",
    "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "gdpr", "comment", "comments", "reply", "replies", "disqus", "respond", "discussion", "form", "login", "signup", "subscribe", "newsletter", "search",
    "share", "social", "related", "recommended", "widget", "pagination", "pager", "copyright", "legal", "contentinfo", "complementary", "toolbar", "tags", "teaser", "dialog",
}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<(?=[a-zA-Z/!?])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<(?=[a-zA-Z/!?])[^>]*+(?:>|\Z)""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LABEL = re.compile(r'data-y="([01])"')
SPACE = re.compile(r"\s+")


class Page:
    """Nodes in page order (a parent comes before its children): parent, features, text (leaves only)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.words, self.text, self.label = [-1], ["html"], ["none"], [None], [None]
        stack, run, links, in_link = [(0, "html")], [], 0, False
        at, end = 0, len(html)

        def close_run() -> None:
            nonlocal links
            if run:
                text = SPACE.sub(" ", unescape("".join(run))).strip()
                run.clear()
                if text:
                    n = len(text)
                    size = 0 if n < 25 else 1 if n < 80 else 2 if n < 250 else 3
                    share = 2 * links >= n
                    self.parent.append(stack[-1][0])
                    self.tag.append("text")
                    self.words.append(("link" if share else "plain") + str(size))
                    self.text.append(text)
                    self.label.append(self.label[stack[-1][0]])
            links = 0

        def pop(names: set[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] in names:
                    del stack[k:]
                    return
                if stack[k][1] in SCOPES:
                    return

        while at < end:
            m = TOKEN.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                run.append(html[at:stop])
                links += (stop - at) * in_link
            if not m:
                break
            at, tag = m.end(), m.group()
            named = NAME.match(tag)
            if not named:
                continue
            name = named[1].lower()
            closing = tag[1] == "/"
            if name in RAW:
                if not closing and not tag.endswith("/>"):
                    close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                    at = close.end() if close else (end if name in ("script", "style", "textarea", "title") else at)
                run.append(" ")
            elif name == "a":
                in_link = not closing
            elif name not in BLOCKS:
                if name == "br":
                    run.append(" ")
                elif name == "hr":
                    close_run()
            elif closing:
                close_run()
                in_link = False
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == name:
                        del stack[k:]
                        break
            else:
                close_run()
                in_link = False
                if name in ("html", "head", "body") and len(stack) > 1 and name != "body":
                    continue
                if name not in ("html", "head"):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][1] == "p":
                            del stack[k:]
                            break
                        if stack[k][1] in SCOPES or stack[k][1] in ("td", "li", "div", "section", "article"):
                            break
                pop(CLOSES.get(name, set()))
                self.parent.append(stack[-1][0])
                self.tag.append("h" if name in HEADINGS else name)
                self.words.append(_words(tag))
                self.text.append(None)
                label = LABEL.search(tag)
                self.label.append(int(label[1]) if label else self.label[stack[-1][0]])
                stack.append((len(self.parent) - 1, name))
        close_run()


@functools.lru_cache(4096)
def _words(tag: str) -> str:
    found = set()
    for m in ATTRIBUTE.finditer(tag):
        found |= set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()))
    return "bad" if found & BAD_WORDS else "good" if found & GOOD_WORDS else "none"


class TreeModel:
    """Potentials as probabilities, by counts with one added to each."""

    def __init__(self, pages: list[Page]):
        edge, seen, feature, values = Counter(), Counter(), Counter(), set()
        for p in pages:
            for i, parent in enumerate(p.parent):
                y = p.label[i] or 0
                feature[y, p.tag[i], p.words[i]] += 1
                values.add((p.tag[i], p.words[i]))
                seen[y] += 1
                if parent >= 0:
                    edge[p.tag[i], p.label[parent] or 0, y] += 1
        kinds = {t for t, _, _ in edge}
        #: P(child | parent), by tag group; unknown tags behave like div
        self.edge = {t: [[(edge[t, a, b] + 0.5) / (edge[t, a, 0] + edge[t, a, 1] + 1) for b in (0, 1)] for a in (0, 1)] for t in kinds}
        #: log odds of a node's features; the elements that every page has once say nothing
        self.evidence = {v: 0.0 if v[0] in WHOLE else math.log((feature[(1, *v)] + 0.5) / (seen[1] + len(values)) * (seen[0] + len(values)) / (feature[(0, *v)] + 0.5)) for v in values}
        self.default = self.edge.get("div", [[0.5, 0.5], [0.5, 0.5]])
        self.root = math.log(0.5)

    def node(self, tag: str, words: str) -> float:
        return self.evidence.get((tag, words), self.evidence.get(("div", words), 0.0))

    def marginals(self, page: Page) -> list[float]:
        """Log odds of content per node, by one upward and one downward sweep."""
        parent, n = page.parent, len(page.parent)
        up = [self.node(t, w) for t, w in zip(page.tag, page.words, strict=True)]
        message = [0.0] * n
        edge, default, exp, log = self.edge, self.default, math.exp, math.log
        for i in range(n - 1, 0, -1):
            (t00, t01), (t10, t11) = edge.get(page.tag[i], default)
            e = up[i]
            if e > 0:
                x = exp(-e)
                m = log((t11 + t10 * x) / (t01 + t00 * x))
            else:
                x = exp(e)
                m = log((t11 * x + t10) / (t01 * x + t00))
            message[i] = m
            up[parent[i]] += m
        belief = up  # a node's own and its subtree's evidence; the part from above is added in page order
        belief[0] += self.root
        for i in range(1, n):
            (t00, t01), (t10, t11) = edge.get(page.tag[i], default)
            o = belief[parent[i]] - message[i]
            if o > 0:
                x = exp(-o)
                belief[i] += log((t11 + t01 * x) / (t10 + t00 * x))
            else:
                x = exp(o)
                belief[i] += log((t11 * x + t01) / (t10 * x + t00))
        return belief

    def extract(self, html: str | None) -> str:
        page = Page(html or "")
        odds = self.marginals(page)
        return "\n".join(t for t, o in zip(page.text, odds, strict=True) if t is not None and o >= 0)


def labelled_pages(n: int = 400, seed: int = 20) -> Iterator[str]:
    """Pages whose elements say in data-y whether they are content."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(500)]
    say = lambda a, b: " ".join(rng.choices(vocabulary, k=rng.randint(a, b)))
    link = lambda: f'<a href="/x">{say(1, 3)}</a>'

    def named(good: bool, *names: str) -> str:
        use = rng.choice(names)
        return "" if rng.random() < 0.2 and not good else f' {rng.choice(("class", "id"))}="{use}"'

    def links(tag: str, names: tuple[str, ...]) -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
        return f'<{tag} data-y="0"{named(tag == "div", *names)}><ul>{items}</ul></{tag}>'

    def junk() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return links(*rng.choice([("nav", ("nav", "menu", "main-nav")), ("div", ("navbar", "menu", "breadcrumbs"))]))
        if kind == 1:
            return f'<div data-y="0" class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo-banner"])}">{"<p>" * (rng.random() < 0.3)}{say(2, 40)}</div>'
        if kind == 2:
            return f'<div data-y="0" class="{rng.choice(["cookie-notice", "consent", "notice", "alert", "popup"])}"><p>{say(5, 40)}</p>{link()}</div>'
        if kind == 3:
            return f'<aside data-y="0"{named(False, "sidebar", "related", "widget")}><h3>{say(1, 3)}</h3><p>{say(5, 60)}</p><ul>{"".join(f"<li>{link()}</li>" for _ in range(4))}</ul></aside>'
        if kind == 4:
            return f'<form data-y="0"{named(False, "login", "search", "newsletter")}><p>{say(2, 20)}</p><div><label>{say(1, 3)}</label><input></div></form>'
        if kind == 5:
            body = "".join(f'<{t} class="comment"><h4>{say(1, 2)}</h4><p>{say(3, 70)}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randint(1, 6)))
            t = rng.choice(["section", "div"])
            return f'<{t} data-y="0" {rng.choice(["id", "class"])}="{rng.choice(["comments", "discussion", "replies"])}"><h2>{say(1, 2)}</h2>{f"<ol>{body}</ol>" if rng.random() < 0.3 else body}</{t}>'
        if kind == 6:
            return f'<header data-y="0"{named(False, "header", "masthead")}><h1>{say(1, 4)}</h1><p>{say(2, 9)}</p>{links("nav", ("menu",)) if rng.random() < 0.5 else ""}</header>'
        if kind == 7:
            return f'<footer data-y="0"{named(False, "footer", "site-footer")}>{rng.choice(["&copy; ", ""])}{say(3, 15)}<p>{link()} {link()}</p></footer>'
        return f'<div data-y="0" class="{rng.choice(["social share", "related", "sidebar", "pagination", "tags"])}">{say(0, 4)} {" ".join(link() for _ in range(4))}</div>'

    def paragraph() -> str:
        kind = rng.randrange(16)
        if kind == 12:
            return f"<div>{say(4, 90)}</div>"
        if kind == 13:
            return f"<div><p>{say(3, 60)}</p><p>{say(8, 120)}</p></div>"
        if kind == 14:
            return f"<section><h2>{say(1, 6)}</h2><div><p>{say(3, 80)}</p></div></section>"
        if kind == 15:
            return say(5, 60) + rng.choice(["<hr>", "<br>", ""])
        if kind == 0:
            return f"<h{rng.randint(2, 4)}>{say(1, 8)}</h2>"
        if kind == 1:
            return f"<ul>{''.join(f'<li>{say(1, 25)}</li>' for _ in range(rng.randint(2, 5)))}</ul>"
        if kind == 2:
            return f"<blockquote><p>{say(4, 50)}</p></blockquote>"
        if kind == 3:
            return f"<table><tr><th>{say(1, 2)}</th><td>{say(1, 9)}</td></tr><tr><td>{say(1, 5)}</td><td>{link()}</td></tr></table>"
        if kind == 4:
            return f"<figure><figcaption>{say(2, 12)}</figcaption></figure>"
        if kind == 5:
            return f"<pre>{say(2, 30)}</pre>"
        if kind == 6:
            return f"<p>{link()}</p>"
        return f"<p>{say(1, 5) if rng.random() < 0.2 else say(8, 120)}{' ' + link() if rng.random() < 0.2 else ''}</p>"

    for _ in range(n):
        body = "".join(junk() if rng.random() < 0.06 else paragraph() for _ in range(rng.randint(1, 20)))
        head = rng.choice([f"<h1>{say(2, 9)}</h1>", f"<h1>{say(2, 9)}</h1><p>{say(4, 20)}</p>", ""])
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        name = named(True, "content", "post", "article-body", "entry-content", "story") if tag in ("div", "section") else named(False, "post", "entry") if rng.random() < 0.4 else ""
        layout = rng.random()
        if layout < 0.15:  # no element holds the article but the body
            before, after = ("".join(junk() for _ in range(rng.randint(0, 2))) for _ in range(2))
            yield f'<html><head><title>{say(1, 5)}</title></head><body data-y="1">{before}{head}{body}{after}</body></html>'
            continue
        if layout < 0.35:
            inner = rng.choice(["div", "section"])
            body = f"<{inner}>{body}</{inner}>"
            if rng.random() < 0.5:
                body = f"<div>{body}</div>"
        body = f'<{tag} data-y="1"{name}>{head}{body}</{tag}>'
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.5:
                body = f'<{rng.choice(["div", "main", "section"])} data-y="1">{body}</div>'
        before, after = ("".join(junk() for _ in range(rng.randint(0, 3))) for _ in range(2))
        inside = f"{before}{body}{after}"
        yield f"<html><head><title>{say(1, 5)}</title></head><body>{f'<div>{inside}</div>' if rng.random() < 0.4 else inside}</body></html>"


@functools.cache
def trained() -> TreeModel:
    return TreeModel([Page(p) for p in labelled_pages()])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = trained()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [model.extract(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(df: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    lean_batches(df.sparkSession)
    own = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
