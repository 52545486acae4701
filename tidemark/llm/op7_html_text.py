"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into blocks at block-level tags by one forward pass. Each block has its
words and link density, those of its neighbours on both sides, and what is known of its
containers: how far tag, role, class and id of the most suspicious one sound like
boilerplate, which share of the page's words it holds, whether it holds a first heading,
whether an article lies inside or around it, and whether the block is apart from the first
heading: no container but one with all of the page's words holds both. A CART tree, grown from a small labelled table,
splits by words and link densities of block and neighbours first, and by all of these below,
so what a container's name is worth depends on the text in and around it. Pages are
handled one by one inside Arrow batches, so nothing is shuffled.

The pass is linear in the page: a tag is read once, a quote or comment that never closes is
looked for once, and open elements are counted by name.

Defined results: null or empty html gives an empty text; a page without kept blocks gives
an empty text; tags left open are closed where their container ends; a closing tag that
nothing opened is ignored; elements with other names (custom ones too) are read as inline
text; a quote that never closes counts as a plain character, a comment that never closes
ends at the next ``>``, a tag that the page's end cuts off is dropped; a very long page is
read whole; repeated rows give repeated results; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op7_labelled_pages import PAGES
from .shared import map_arrow, read_table

#: Elements whose content is raw text up to their closing tag and never text of a page.
RAW = frozenset("script style noscript iframe title textarea xmp noembed noframes".split())
#: Elements whose content is never text either, but which end with their container at the latest.
SILENT = frozenset("head template svg object canvas math select button".split())
#: What may stand in a head; any other tag or text ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
#: The rest of a tag; a quote counts after "=" only. Possessive, so it never goes back.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTRIBUTE = re.compile(r"([^\s=/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CONTAINERS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_NEXT = {"p": CONTAINERS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words in class or id that often mark what isn't main text.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notices popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menus breadcrumb breadcrumbs pagination pager sidebar widget widgets "
    "related recommended recommendations trending share sharing social comment comments disqus respond reply replies footer footnav toolbar topbar "
    "masthead copyright opinions discussion discussions responses feedback talkback guestbook reader readers opinion".split()
)
#: Words that say it less often; they count half.
WEAK_WORDS = frozenset("search form legal menu notice alert popular aside skip reviews thread".split())
#: Words of every kind of container, which say nothing.
NEUTRAL_WORDS = frozenset("section box block container wrapper area inner div list item post posts group".split())
OWN = ("words", "links", "mark", "share", "title", "article", "within", "apart", "heading", "item")
#: First levels of the tree that split by words and link densities only.
TEXT_LEVELS, TEXT_FEATURES = 1, 6
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", *OWN[2:])


def mark(tag: str, attributes: str, in_article: bool) -> float:
    """How much an element sounds like boilerplate: 1 by its tag, role or being hidden, else the share of such words among the telling ones in class and id."""
    if tag in BOILER_TAGS or tag == "header" and not in_article:
        return 1.0
    parts: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*+:\s*+none", value, re.I):
            return 1.0
        if name == "role" and value.lower() in BOILER_ROLES:
            return 1.0
        if name in ("class", "id"):
            parts += [x.lower() for x in PART.findall(value)]
    said = [0.5 if x in WEAK_WORDS else 1.0 if x in BOILER_WORDS or x == "header" and not in_article else 0.0 for x in parts]
    # Neutral words count only where there is nothing else.
    telling = sum(x not in NEUTRAL_WORDS for x in parts)
    return sum(said) / telling if telling else 0.0


class Page:
    """Containers and blocks of one page, in page order."""

    def __init__(self) -> None:
        self.parent, self.tag, self.mark, self.article, self.labelled = [-1], [""], [0.0], [-1], [False]
        self.silent, self.children = [False], [0]
        self.stack, self.open = [0], Counter()
        self.blocks: list[tuple[str, int, int, int]] = []  # text, container, words, linked words
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.in_link = self.fleeting = False

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                n = text.count(" ") + 1
                self.blocks.append((text, self.stack[-1], n, min(n, len("".join(self.linked).split()))))
        self.pieces.clear()
        self.linked.clear()

    def push(self, tag: str, attributes: str, silent: bool) -> None:
        up = self.stack[-1]
        article = self.article[up]
        self.parent.append(up)
        self.tag.append(tag)
        self.mark.append(0.0 if silent else mark(tag, attributes, article >= 0))
        self.article.append(len(self.tag) - 1 if tag in ("article", "main") else article)
        self.labelled.append(self.labelled[up] or "data-main" in attributes)
        self.silent.append(silent or self.silent[up])
        self.children[up] += 1
        self.children.append(0)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1

    def pop(self) -> str:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        return tag

    def close(self, *tags: str) -> None:
        """Ends the innermost open element of these names and all in it."""
        while self.pop() not in tags:
            pass

    def quiet(self) -> bool:
        return self.silent[self.stack[-1]]

    def speak(self) -> None:
        """Leaves what is silent; blocks go on where it began."""
        while self.quiet():
            self.pop()

    def say(self, s: str) -> None:
        if self.quiet():
            if self.tag[self.stack[-1]] != "head" or not s.strip():
                return
            self.pop()
        if "&" in s:
            s = html.unescape(s)
        self.pieces.append(s)
        if self.in_link:
            self.linked.append(s)

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        """An opening tag; ``closed``: a closing tag of that name follows somewhere (told of silent elements only)."""
        if self.quiet() and tag not in IN_HEAD and (tag == "body" and self.open["head"] or self.tag[self.stack[-1]] == "head"):
            self.close("head")
        if tag in SILENT:
            if not attributes.endswith("/"):
                if tag in ("select", "button") and self.open[tag]:
                    self.close(tag)
                # Among blocks an element that nothing closes ends with the next block, else with its container.
                self.fleeting = not closed and tag != "head" and self.children[self.stack[-1]] > 0 and not self.quiet()
                self.push(tag, "", True)
        elif tag in CONTAINERS:
            if self.fleeting and self.quiet():
                self.speak()
            if not self.quiet():
                self.flush()
                self.in_link = False
            while self.tag[self.stack[-1]] in CLOSED_BY_NEXT and tag in CLOSED_BY_NEXT[self.tag[self.stack[-1]]]:
                self.pop()
            if tag != "hr" and not attributes.endswith("/"):
                self.push(tag, attributes, False)
        elif not self.quiet():
            if tag == "br":
                self.say(" ")
            elif tag == "a":
                self.in_link = True
                if self.linked:
                    self.linked.append(" ")

    def end(self, tag: str) -> None:
        if tag in CONTAINERS:
            if self.open[tag] == 0:
                if not self.quiet():
                    self.flush()
                return
            if self.quiet():
                # Inside the silent element it ends what was opened there; else it ends the silent element too.
                top = len(self.stack) - 1
                while not self.tag[self.stack[top]] == tag:
                    top -= 1
                if not self.silent[self.stack[top]]:
                    self.speak()
            if not self.quiet():
                self.flush()
                self.in_link = False
            self.close(tag)
        elif tag in SILENT:
            if self.quiet() and self.open[tag]:
                self.close(tag)
        elif tag == "a" and not self.quiet():
            self.in_link = False


def read_page(page: str) -> Page:
    out = Page()
    at = begin = 0
    plain = no_comment = False
    closers: dict[str, int] = {}

    def closer(tag: str, at: int) -> int:
        """Where the next closing tag of this name stands, or -1."""
        if tag not in closers or 0 <= closers[tag] < at:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            closers[tag] = found.start() if found else -1
        return closers[tag]

    while m := OPEN.search(page, at):
        if m.start() > begin:
            out.say(page[begin : m.start()])
        if m[3]:
            end = -1 if no_comment else page.find("-->", m.start() + 2)
            no_comment = end < 0
            at = end + 3 if end >= 0 else page.find(">", m.end()) + 1
        elif m[2] is None:
            at = page.find(">", m.end()) + 1
        else:
            tag = m[2].lower()
            rest = None if plain else REST.match(page, m.end())
            if rest is None:  # quotes don't close from here on
                plain = True
                at = page.find(">", m.end()) + 1
            else:
                at = rest.end()
            if at:
                attributes = page[m.end() : at - 1]
                if tag not in RAW:
                    if m[1]:
                        out.end(tag)
                    else:
                        out.start(tag, attributes, tag not in SILENT or closer(tag, at) >= 0)
                elif not m[1] and not (out.open["svg"] or out.open["math"]):
                    # Raw text; without a closing tag only what can't be text goes.
                    if out.quiet() and out.tag[out.stack[-1]] == "head" and tag not in IN_HEAD:
                        out.close("head")
                    found = closer(tag, at)
                    if found >= 0:
                        at = found
                    elif tag in ("script", "style") and not attributes.endswith("/"):
                        at = 0
        begin = at
        if at == 0:  # nothing but what is cut off follows
            begin = len(page)
            break
    if begin < len(page):
        out.say(page[begin:])
    out.speak()
    out.flush()
    return out


def blocks(page: str) -> list[tuple[str, list[float], bool]]:
    """Text, own features (``OWN``) and training mark of every block of a page, in page order."""
    p = read_page(page)
    n = len(p.tag)
    words, titles = [0] * n, [t == "h1" for t in p.tag]
    for _, at, size, _ in p.blocks:
        words[at] += size
    for i in range(n - 1, 0, -1):
        words[p.parent[i]] += words[i]
        titles[p.parent[i]] += titles[i]
    total = max(1, words[0])
    # The most suspicious container around: much of a mark, little of the page.
    worst = [(0.0, -1)] * n
    for i in range(1, n):
        worst[i] = max(worst[p.parent[i]], (p.mark[i] * (1 - words[i] / total), i)) if p.mark[i] else worst[p.parent[i]]
    # Blocks are together with the first heading where a container holds both and not all of the page's words.
    heading = next((at for _, at, _, _ in p.blocks if p.tag[at] == "h1"), next((at for _, at, _, _ in p.blocks if p.tag[at] in HEADINGS), 0))
    inmost = p.parent[heading] if heading else 0
    together = [False] * n
    while inmost > 0 and words[inmost] < total:
        together[inmost], inmost = True, p.parent[inmost]
    for i in range(1, n):
        together[i] = together[i] or together[p.parent[i]]
    some = any(together)
    out = []
    for text, at, size, linked in p.blocks:
        suspicion, w = worst[at]
        marked = suspicion > 0
        own = [
            size, linked / size, p.mark[w] if marked else 0.0, words[w] / total if marked else 1.0, float(marked and titles[w] > 0),
            float(p.article[at] >= 0 and (not marked or p.article[at] >= w)), float(p.article[at] >= 0), 0.5 if not some else float(not together[at]), float(p.tag[at] in HEADINGS), float(p.tag[at] == "li"),
        ]
        out.append((text, own, p.labelled[at]))
    return out


def features(found: list[list[float]]) -> np.ndarray:
    """The features of the blocks of one page with those of the neighbours."""
    own = np.array(found, float).reshape(-1, len(OWN))
    pad = np.zeros((1, 2))
    around = np.concatenate([pad, own[:, :2], pad])
    return np.column_stack([own[:, :2], around[:-2], around[2:], own[:, 2:]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2, text_levels: int = TEXT_LEVELS) -> list[tuple[int, float, int, int, float]]:
    """CART with Gini impurity; nodes are (feature or -1, threshold, left, right, share of kept).

    The first ``text_levels`` split by the first ``TEXT_FEATURES`` features only.
    """
    nodes: list[tuple[int, float, int, int, float]] = []

    def node(rows: np.ndarray, level: int) -> int:
        me, share = len(nodes), float(y[rows].mean())
        nodes.append((-1, 0.0, -1, -1, share))
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        if level < depth and 0 < share < 1:
            for f in range(TEXT_FEATURES if level < text_levels else x.shape[1]):
                for t in np.unique(x[rows, f])[:-1]:
                    side = x[rows, f] <= t
                    a, b = y[rows][side], y[rows][~side]
                    if min(len(a), len(b)) >= least:
                        score = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                        upper = x[rows, f][x[rows, f] > t].min()
                        best = min(best, (score, f, (t + upper) / 2))
        if best[1] >= 0:
            side = x[rows, best[1]] <= best[2]
            left = node(rows[side], level + 1)
            right = node(rows[~side], level + 1)
            nodes[me] = (best[1], best[2], left, right, share)
        return me

    node(np.arange(len(y)), 0)
    return nodes


def classify(tree: list[tuple[int, float, int, int, float]], x: np.ndarray) -> np.ndarray:
    table = np.array(tree)
    at = np.zeros(len(x), np.int64)
    while len(open_ := np.flatnonzero(table[at, 0] >= 0)):
        node = table[at[open_]]
        at[open_] = np.where(x[open_, node[:, 0].astype(np.int64)] <= node[:, 1], node[:, 2], node[:, 3]).astype(np.int64)
    return table[at, 4] >= 0.5


def train(pages: tuple[str, ...] = PAGES) -> list[tuple[int, float, int, int, float]]:
    """The tree from labelled pages: blocks in an element with ``data-main`` are main text."""
    found = [blocks(p) for p in pages]
    x = np.concatenate([features([b[1] for b in page]) for page in found])
    y = np.array([b[2] for page in found for b in page], float)
    return grow(x, y)


def main_text(page: str | None, tree: list[tuple[int, float, int, int, float]]) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    kept = classify(tree, features([b[1] for b in found]))
    return "\n\n".join(b[0] for b, k in zip(found, kept, strict=True) if k)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html", labelled: tuple[str, ...] = PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_column).cast("string").alias("html"))
    tree = train(labelled)
    schema = f"page_id {narrow.schema[0].dataType.simpleString()}, url {narrow.schema[1].dataType.simpleString()}, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                text = [main_text(x.as_py(), tree) for x in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return map_arrow(narrow, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))
