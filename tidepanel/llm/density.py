"""Main text of HTML pages by composite text density.

Every page is parsed into a tree that forgives unclosed and crossed tags. Subtrees that are no running text by their tag
or role (menus, footers, adverts, forms, reader comments ...) are left out, unless they stand around the page's article or
most of its text. Every remaining block node gets its
link-adjusted number of characters per tag; the path from the body to the densest node gives the threshold, and among
the nodes that reach it the one with the largest sum over its children holds the text. What stands in a block beside its
inner blocks counts as one more child, by the same measure. No tag decides which node that is.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.common import map_arrow

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
SPACED = set("br td th img".split())
CLOSES_PARAGRAPH = BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "option", "optgroup", "legend"}
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                     "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
          "tbody": {"table"}, "tfoot": {"table"}}
# Elements, roles and words of class or id that mark what is no article text.
NEVER_TAGS = set("head script style noscript template button select textarea input iframe object svg math canvas audio video title xmp noembed noframes".split())
NO_TEXT_TAGS = set("nav aside footer dialog menu search".split())
NO_TEXT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist".split())
NO_TEXT_WORDS = set("ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal "
                    "overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar sidenav footer masthead topbar toolbar "
                    "pagination pager share sharing social comment comments disqus respond replies related recommended widget".split())

TOKEN = re.compile(r"<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.S)
LENIENT = re.compile(r"<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s/][^\s/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|(\S*+)))?", re.S)
#: Marks of a node: a word of class or id at an article, which only counts where articles are compared; a form or such a
#: word elsewhere; a tag or role that is no article text; what is never text.
OWN_WORD, WORD, PART, NEVER = 1, 2, 3, 4
OPENING = re.compile(r"<[a-zA-Z/]")


class Tree:
    """Nodes by number; parents come before their children."""

    def __init__(self) -> None:
        self.tag, self.parent, self.mark = ["html"], [-1], [0]
        #: text pieces in page order: (node, text); None stands for the edge of a block
        self.text: list[tuple[int, str | None]] = []


def _attributes(source: str) -> dict[str, str]:
    """Attributes of a tag by name, in small letters: name by name, each with its value, the first of equal names. A quote
    that never ends runs to the end."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), "".join(values).lower())
    return found


def _mark(tag: str, attributes: str, in_article: bool) -> int:
    if tag in NEVER_TAGS:
        return NEVER
    held = _attributes(attributes) if "=" in attributes or "hidden" in attributes.lower() else {}
    if "hidden" in held or held.get("aria-hidden") == "true":
        return NEVER
    if tag in NO_TEXT_TAGS or tag == "header" and not in_article or held.get("role") in NO_TEXT_ROLES:
        return PART
    if tag == "form" or held.get("role") == "form":
        return WORD
    words = re.split(r"[^a-z0-9]+", f"{held.get('class', '')} {held.get('id', '')}") if held else ()
    if tag in ("html", "body") or NO_TEXT_WORDS.isdisjoint(words):
        return 0
    return OWN_WORD if tag in ("article", "main") else WORD


def left_out(tree: Tree) -> list[bool]:
    """Nodes whose text is left out: those with a mark and all below them.

    A mark is lifted where it would take the page's text along. That is above a ``main``, above an article that holds
    most of the text outside menus and the like, and above the least marked articles if no unmarked one is there and they
    hold more than stands open. A page without any article has its forms and class or id words lifted above most of its
    text, or above a heading of the first level with a quarter of it, as long as less than a quarter stands open and such
    headings are not elsewhere only.
    """
    count, mark, parent = len(tree.tag), tree.mark, tree.parent
    lifted = [False] * count

    def skipped() -> list[bool]:
        skip = [False] * count
        for n in range(1, count):
            skip[n] = skip[parent[n]] or mark[n] == NEVER or mark[n] in (WORD, PART) and not lifted[n]
        return skip

    skip = skipped()
    if WORD not in mark and PART not in mark:
        return skip
    whole, depth, under = [0] * count, [0] * count, [0] * count  # marks above and at a node: how many, and the strongest
    for n, piece in tree.text:
        if piece:
            whole[n] += sum(map(len, piece.split()))
    open_ = whole[:]
    for n in range(count - 1, 0, -1):
        if mark[n] < PART:
            whole[parent[n]] += whole[n]
        if mark[n] < WORD:
            open_[parent[n]] += open_[n]
    for n in range(1, count):
        depth[n] = depth[parent[n]] + (mark[n] in (WORD, PART))
        under[n] = max(under[parent[n]], mark[n])

    def lift(nodes: list[int]) -> None:
        for n in nodes:
            while n > 0 and not lifted[n]:
                lifted[n] = True
                n = parent[n]

    articles = [n for n in range(1, count) if tree.tag[n] in ("article", "main") and under[n] < NEVER and open_[n] and (mark[n] != OWN_WORD or tree.tag[n] == "main")]
    if articles:
        least = min(depth[n] for n in articles)
        first = [n for n in articles if depth[n] == least]
        if not least or sum(open_[n] for n in first) <= open_[0]:
            first = []
        lift(first + [n for n in articles if tree.tag[n] == "main" or under[n] < PART and 2 * open_[n] > whole[0]])
        return skipped()
    above = [0] * count  # nearest marked node above
    below: dict[int, list[int]] = {}
    heads: dict[int, int] = {}  # headings of the first level by the nearest marked node
    for n in range(1, count):
        above[n] = parent[n] if mark[parent[n]] in (WORD, PART, NEVER) else above[parent[n]]
        if mark[n] == WORD:
            below.setdefault(above[n], []).append(n)
        if tree.tag[n] == "h1" and whole[n] and mark[n] < WORD:
            heads[above[n]] = heads.get(above[n], 0) + 1
    headed = [False] * count
    for n in heads:
        while n > 0 and not headed[n]:
            headed[n] = True
            n = parent[n]
    at, shown, outside = 0, open_[0], bool(heads.get(0))
    while at in below:
        titled = [n for n in below[at] if headed[n] and 4 * whole[n] > whole[0]]
        at = max(titled or below[at], key=lambda n: (whole[n], -n))
        if shown and (2 * whole[at] <= whole[0] and not titled or 4 * shown >= whole[0] or outside and not headed[at]):
            break
        lifted[at] = True
        shown, outside = shown + open_[at], outside or bool(heads.get(at))
    return skipped()


def parse(page: str) -> Tree:
    """Tree of a page. A tag that the page's end cuts off is dropped."""
    tree = Tree()
    open_ = [0]
    count = {"html": 1}  # open elements by tag
    at, pattern, size = 0, TOKEN, len(page)

    def text(piece: str) -> None:
        if piece:
            tree.text.append((open_[-1], html.unescape(piece)))

    def pop_to(depth: int) -> None:
        for node in open_[depth:]:
            count[tree.tag[node]] -= 1
            if tree.tag[node] in BLOCK:
                tree.text.append((node, None))
        del open_[depth:]

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        match = pattern.match(page, start)
        if not match and pattern is TOKEN and OPENING.match(page, start) and (loose := LENIENT.match(page, start)):
            pattern, match = LENIENT, loose  # a quote that never ends: quotes don't count from here on
        if not match:
            text(page[at:start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = match.end()
        if not match[2]:
            continue
        if pattern is LENIENT and page[at - 1] != ">":
            break
        tag = match[2].lower()
        if match[1]:
            depth = next((d for d in range(len(open_) - 1, 0, -1) if tree.tag[open_[d]] == tag), 0) if count.get(tag) else 0
            if depth and tag not in ("body", "html"):
                pop_to(depth)
            continue
        if tag in ("html", "body") and (tag == "html" or count.get("body")):
            continue
        if tag in CLOSES_PARAGRAPH and count.get("p"):
            depth = next((d for d in range(len(open_) - 1, 0, -1) if tree.tag[open_[d]] == "p"), 0)
            if depth:
                pop_to(depth)
        if tag == "body":
            pop_to(1)
        if tag in CLOSED_BY_SIBLING:
            for depth in range(len(open_) - 1, 0, -1):
                kind = tree.tag[open_[depth]]
                if kind in SCOPES[tag]:
                    break
                if kind in CLOSED_BY_SIBLING[tag]:
                    pop_to(depth)
                    break
        node = len(tree.tag)
        above = open_[-1]
        tree.tag.append(tag)
        tree.parent.append(above)
        tree.mark.append(_mark(tag, match[3], bool(count.get("article") or count.get("main"))))
        if tag in BLOCK:
            tree.text.append((node, None))
        elif tag in SPACED:
            tree.text.append((above, " "))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if not match[3].endswith("/") or tag in BLOCK:
            open_.append(node)
            count[tag] = count.get(tag, 0) + 1
    return tree


def main_text(page: str | None) -> str:
    """Text of the node with the largest density sum, one line per block; empty for a page without text."""
    if not page:
        return ""
    tree = parse(page)
    count, skip = len(tree.tag), left_out(tree)
    block = [tree.tag[n] in BLOCK and not skip[n] for n in range(count)]
    block[0] = True
    home = [0] * count  # nearest block
    link = [False] * count
    for n in range(1, count):
        home[n] = n if block[n] else home[tree.parent[n]]
        link[n] = tree.tag[n] == "a" or link[tree.parent[n]]
    chars, tags, link_chars, link_tags = [0] * count, [0] * count, [0] * count, [0] * count
    # what a block holds outside its inner blocks counts like one more block: text, inline tags and links alike
    own, own_tags, own_link_chars, own_link_tags = [0] * count, [0] * count, [0] * count, [0] * count
    for n, piece in tree.text:
        if piece and not skip[n]:
            size = sum(map(len, piece.split()))
            chars[n] += size
            link_chars[n] += size * link[n]
            own[home[n]] += size
            own_link_chars[home[n]] += size * link[n]
    for n in range(1, count):
        if not block[n] and not skip[n]:
            own_tags[home[n]] += 1
            own_link_tags[home[n]] += tree.tag[n] == "a"
    for n in range(count - 1, 0, -1):
        above = tree.parent[n]
        if not skip[n]:
            chars[above] += chars[n]
            link_chars[above] += link_chars[n]
            tags[above] += tags[n] + 1
            link_tags[above] += link_tags[n] + (tree.tag[n] == "a")
    root = next((n for n in range(count) if tree.tag[n] == "body"), 0)
    if not chars[root]:
        root = 0
    if not chars[root]:
        return ""
    share = link_chars[root] / chars[root]

    def density(c: int, t: int, lc: int, lt: int) -> float:
        """Characters per tag, scaled down as links hold more of them."""
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / max(t, 1) * max(0.0, math.log(max(c, 1) / max(lc, 1) * max(t, 1) / max(lt, 1) + 1)) / max(1.0, math.log(base))

    dense = [density(chars[n], tags[n], link_chars[n], link_tags[n]) if block[n] else 0.0 for n in range(count)]
    total = [density(own[n], own_tags[n], own_link_chars[n], own_link_tags[n]) for n in range(count)]
    for n in range(count - 1, 0, -1):
        if block[n]:
            total[home[tree.parent[n]]] += dense[n]
    inside = [False] * count
    inside[root] = True
    for n in range(root + 1, count):
        inside[n] = inside[tree.parent[n]]
    nodes = [n for n in range(count) if block[n] and inside[n]]
    path, n = [], max(nodes, key=lambda n: (dense[n], -n))
    while n >= 0:
        if block[n]:
            path.append(n)
        if n == root:
            break
        n = tree.parent[n]
    threshold = min(dense[n] for n in path)
    best = max((n for n in nodes if dense[n] >= threshold), key=lambda n: (total[n], -n))
    # an inner part of the text may be the densest: the block around it is taken as long as nothing beside the part is
    # made of links, below the body
    beside: dict[int, list[int]] = {}
    for n in nodes:
        if n != root and chars[n]:
            beside.setdefault(home[tree.parent[n]], []).append(n)
    while best != root and (around := home[tree.parent[best]]) != root:
        if any(n != best and link_chars[n] and dense[n] < threshold for n in beside[around]):
            break
        best = around
    chosen = [False] * count
    chosen[best] = True
    for n in range(best + 1, count):
        chosen[n] = chosen[tree.parent[n]] and not skip[n]
    lines: list[str] = []
    held: list[str] = []
    for n, piece in [*tree.text, (0, None)]:
        if piece is None:
            if line := " ".join("".join(held).split()):
                lines.append(line)
            held = []
        elif chosen[n]:
            held.append(piece)
    return "\n".join(lines)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars).

    A null or empty page has an empty text. Rows stand for themselves: repeated rows and null ids stay. Other columns are
    not read, whatever their names. An empty table gives an empty one. No part of a page is cut off for its size.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                                 names=[page_id, url, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}
    return map_arrow(pages.select(page_id, url, page), work, f"{page_id} {kinds[page_id]}, {url} {kinds[url]}, text string, n_chars long")
