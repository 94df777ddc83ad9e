"""Main text of web pages by wrapper induction."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import checked_broadcast
from civicmill.session import cut_lineage

DEEPEST = 150  # levels of elements told apart
REFERENCES = 4  # pages of a host that are aligned to induce its wrapper
WRAPPERS_BROADCAST = 20_000  # hosts up to which the wrappers, a few kB each, may be broadcast

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
GONE = frozenset("head nav footer aside form button select option fieldset menu dialog object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# words of class names and ids that mark what is no article
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promos promotion promoted banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar sidebar sidebars rail widget widgets "
    "footer comment comments reply replies respond discussion disqus share sharing social related recommended recommendations search login signup form".split()
)
UNLESS = frozenset("no without with has".split())


class Node:
    __slots__ = ("label", "children", "own", "gone", "end", "number", "tag", "links", "plain")

    def __init__(self, tag: str, label: str, gone: bool, number: int):
        self.tag, self.label, self.gone, self.number = tag, label, gone, number
        self.children: list[Node] = []
        self.own: list[str] = []
        self.end = number
        self.links, self.plain = 0, False  # blocks of link text alone; whether any text stands outside links


def marked(attributes: str) -> bool:
    for found in ATTRIBUTE.finditer(attributes):
        value = (found[2] or found[3] or found[4] or "").lower()
        if found[1].lower() == "role":
            if value.strip() in ROLES:
                return True
            continue
        for name in value.split():
            words = [w for w in re.split(r"[-_:]+", name) if w]
            if words and not UNLESS & set(words) and (words[0].rstrip("0123456789") in MARKS or words[-1].rstrip("0123456789") in MARKS):
                return True
    return False


def header_like(tag: str, attributes: str) -> bool:
    return tag == "header" or bool(re.search(r"\b(?:class|id)\s*=\s*[\"']?[^\"'>]*\b(?:site|page|top|global|main)?-?(?:header|masthead)\b", attributes, re.I))


def parse(html: str) -> tuple[Node, list[tuple[int, bool, str]]]:
    """The tree of block elements, and the blocks of text in page order: (number of its node, not content, text).

    Inline elements cut no text. Outside an article, three or more blocks that are links and nothing else are a menu. An open paragraph ends where another block begins, unmatched end tags are ignored,
    and what is still open at the end is closed there. Raw elements hold no markup.
    """
    root = Node("#", "#", False, 0)
    stack, blocks, buffer, count, at = [root], [], [], 1, 0
    in_link, plain = 0, False
    deep: list[str] = []  # open elements below the deepest level kept: their text belongs to that level

    def flush() -> None:
        nonlocal plain
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                node = stack[-1]
                node.own.append(text)
                node.plain |= plain
                node.links += not plain
                blocks.append((node.number, node.gone, text))
        plain = False

    def put(text: str) -> None:
        nonlocal plain
        buffer.append(text)
        plain = plain or (not in_link and not text.isspace())

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            stack.pop().end = count

    search = TOKEN.search
    while True:
        found = search(html, at)
        if not found:
            put(html[at:])
            break
        if found.start() > at:
            put(html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not found[1]:
            if found[3].endswith("/") and tag == "svg":
                continue
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            if tag not in ("script", "style", "template"):
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if found[1] else 1
            if not found[1] and tag not in VOID and marked(found[3]) and tag == "span":
                flush()
                node = Node(tag, tag + "!", True, count)
                stack[-1].children.append(node)
                count += 1
                stack.append(node)
            elif found[1] and stack[-1].tag == tag:
                close(len(stack) - 1)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        in_link = 0  # a link left open ends with its block
        if found[1]:
            if tag in deep:
                flush()
                while deep.pop() != tag:
                    pass
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            else:
                flush()
            continue
        flush()
        if tag in VOID:
            continue
        if len(stack) >= DEEPEST:
            if not found[3].endswith("/"):
                deep.append(tag)
            continue
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p" or (tag == "li" and stack[depth].tag == "li"):
                close(depth)
                break
            if stack[depth].tag not in ("span",):
                break
        above = stack[-1]
        inside = tag in ("article", "main", "html", "body") or any(n.tag in ("article", "main") for n in stack)
        gone = above.gone or tag in GONE or (tag not in ("html", "body", "main") and marked(found[3])) or (not inside and header_like(tag, found[3]))
        name = ATTRIBUTE.search(found[3])
        label = f"{tag}.{(name[2] or name[3] or name[4] or '').lower()}" if name else tag
        node = Node(tag, re.sub(r"\d+", "0", label), gone, count)
        count += 1
        above.children.append(node)
        if not found[3].endswith("/"):
            stack.append(node)
        node.end = count
    close(0)
    root.end = count
    menus = list(link_lists(root)[0])
    if menus:
        blocks = [(n, gone or any(a <= n < b for a, b in menus), t) for n, gone, t in blocks]
    return root, blocks


def link_lists(node: Node) -> tuple[list[tuple[int, int]], int, bool]:
    """(ranges of the menus at or below ``node``, which are marked as gone; its blocks of links; any other text)."""
    if node.gone or node.tag in ("article", "main"):
        return [], 0, True
    ranges, links, plain = [], node.links, node.plain
    for child in node.children:
        below, n, other = link_lists(child)
        ranges += below
        links += n
        plain |= other
    if not plain and links >= 3 and node.tag not in ("#", "html", "body"):
        node.gone = True
        return [(node.number, node.end)], 0, False
    return ranges, links, plain


# An aligned tree is [label, hash of its texts, length of its texts, in the article, number, children]. Runs of equal
# sibling leaves are one node, as a wrapper's repeated slot is.
Tree = list


def outline(node: Node, in_article: bool = False) -> Tree:
    in_article = in_article or node.tag == "article"
    children: list[Tree] = []
    for child in node.children:
        if child.gone:
            continue
        made = outline(child, in_article)
        last = children[-1] if children else None
        if last and not made[5] and not last[5] and made[0] == last[0]:
            last[1] = xxhash.xxh32_intdigest(f"{last[1]} {made[1]}")
            last[2] += made[2]
        else:
            children.append(made)
    text = " ".join(node.own)
    return [node.label, xxhash.xxh32_intdigest(text), len(text), in_article, node.number, children]


def match(a: Tree, b: Tree) -> tuple[int, list]:
    """Simple tree matching: the size of the largest order-preserving top-down matching, and its pairs of nodes."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[5], b[5]
    size, pairs = 1, [(a, b)]
    if x and y:
        each = [[match(p, q) if p[0] == q[0] else (0, []) for q in y] for p in x]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            row, up = best[i + 1], best[i]
            for j in range(len(y)):
                row[j + 1] = max(up[j + 1], row[j], up[j] + each[i][j][0])
        i, j = len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                pairs += each[i - 1][j - 1][1]
                i, j = i - 1, j - 1
        size += best[len(x)][len(y)]
    return size, pairs


def nodes_of(tree: Tree) -> Iterator[Tree]:
    yield tree
    for child in tree[5]:
        yield from nodes_of(child)


def slot_of(tree: Tree, constant: set[int]) -> int:
    """Number of the lowest node that holds all varying text: of articles, if any has some, else of the page."""
    weight = {n[4]: n[2] if n[4] not in constant else 0 for n in nodes_of(tree)}
    if any(n[3] and weight[n[4]] for n in nodes_of(tree)):
        weight |= {n[4]: 0 for n in nodes_of(tree) if not n[3]}
    if not any(weight.values()):
        weight = {n[4]: n[2] for n in nodes_of(tree)}

    def total(n: Tree) -> int:
        return weight[n[4]] + sum(map(total, n[5]))

    node = tree
    while not weight[node[4]]:
        held = [c for c in node[5] if total(c)]
        if len(held) != 1:
            break
        # a repeated leaf stands for all its siblings, so its parent is the slot
        if not held[0][5] and held[0][0].split(".")[0] != "article":
            break
        node = held[0]
    return node[4]


def induce(pages: list[str]) -> str:
    """The wrapper of a host: the outline of one page, its constant nodes, and the slot that holds what varies."""
    trees = [outline(parse(p)[0]) for p in pages]
    first, others = trees[0], trees[1:]
    same = {n[4]: 0 for n in nodes_of(first)}
    for other in others:
        for a, b in match(first, other)[1]:
            same[a[4]] += a[1] == b[1]
    constant = {n for n, k in same.items() if others and k == len(others)}
    return json.dumps([first, sorted(constant), slot_of(first, constant)], separators=(",", ":"))


def main_text(html: str | None, wrapper: str | None) -> str:
    """Blocks of the page's node that is aligned with the wrapper's slot, in page order.

    Nodes aligned with a constant one, and equal to it, are template and left out, save inside an article, where
    passages that pages share are content. Without a match the page's own text decides.
    """
    if not html:
        return ""
    root, blocks = parse(html)
    kept = [b for b in blocks if not b[1]]
    if not kept:
        return ""
    tree = outline(root)
    slot, template = None, set()
    if wrapper:
        first, constant, at = json.loads(wrapper)
        constant = set(constant)
        for a, b in match(first, tree)[1]:
            if a[4] == at:
                slot = b[4]
            if a[4] in constant and a[1] == b[1] and b[2] and not b[3]:
                template.add(b[4])
    spans = {}

    def number(n: Node) -> None:
        spans[n.number] = n.end
        for c in n.children:
            number(c)

    number(root)
    articles = [n[4] for n in nodes_of(tree) if n[0].split(".")[0] == "article"]

    def within(start: int) -> list[str]:
        return [t for n, _, t in kept if start <= n < spans[start] and n not in template]

    text = within(slot) if slot is not None else []
    if not text or (articles and not any(slot <= n < spans[slot] or n <= slot < spans[n] for n in articles)):
        template = set()
        text = within(slot_of(tree, set()))
    return " ".join(text)


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", row_id: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    For each host, up to ``REFERENCES`` pages with the smallest hashes are aligned by simple tree matching: what all
    have alike is template, what varies is the slot. Only those references are gathered, a bounded number a host;
    every page is then read once, aligned with its host's wrapper and reduced to the slot. Menus, headers, footers,
    sidebars, notices, adverts, forms and reader comments are known by element, role or name and never content, since
    their texts vary too.

    Null or empty html gives an empty text; a null url shares the empty host. A host with a single page, or with equal
    pages only, has no constant part: its text decides alone. Repeated rows and ids stay. Other columns are ignored.
    """
    from civicmill.llm.urls import url_host

    rows = pages.select(F.col(row_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), url_host(F.col(url)).alias("host"))
    marks = rows.filter("html <> ''").select("host", F.xxhash64("html").alias("mark"))
    chosen = marks.groupBy("host", F.pmod("mark", F.lit(REFERENCES)).alias("part")).agg(F.min("mark").alias("mark"))
    chosen = cut_lineage(chosen)
    n_chosen = chosen.count()
    seen = rows.filter("html <> ''").select("host", "html").withColumn("mark", F.xxhash64("html"))
    references = seen.join(checked_broadcast(chosen.select("host", "mark"), n_chosen, REFERENCES * WRAPPERS_BROADCAST), ["host", "mark"])
    # copies of a reference are one: equal hashes
    references = references.groupBy("host", "mark").agg(F.first("html").alias("html"))

    def one_host(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("mark")
        return pd.DataFrame({"host": frame["host"].iloc[:1], "wrapper": [induce(list(frame["html"]))]})

    wrappers = cut_lineage(references.groupBy("host").applyInPandas(one_host, "host string, wrapper string"))
    joined = rows.join(checked_broadcast(wrappers, n_chosen, REFERENCES * WRAPPERS_BROADCAST), "host", "left")

    @F.pandas_udf("string")
    def extract(html: pd.Series, wrapper: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, w) for h, w in zip(html, wrapper, strict=True)], dtype=object)

    texts = joined.select("page_id", "url", extract("html", "wrapper").alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
