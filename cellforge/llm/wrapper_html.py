"""Main text of pages by wrapper induction.

First pass: up to REFERENCES pages of each host, of different html and chosen by hashes of it, are aligned in pairs by simple tree
matching. The DOM trees, without inline tags, are matched from the root, children in order, so that the weight of
matched nodes is largest: equal labels count one, equal text two more. A node whose text two other references
have in its place (one, where a host has only two different pages) is constant and belongs to the host's template; it is
strong if all references, three at least, have it. All else is a varying slot. The template, constant nodes with their ancestors, is stored: it is small
whatever the pages' size. The matching is over the nodes that may be constant (a node of the other tree has their label and
text) and their ancestors. Equal subtrees at both ends of two rows of children are matched at once, and tables larger than
TABLE cells are solved in linear memory; neither changes the largest weight.

Second pass: each page is aligned with its host's template alone, so no page is compared with all others, and no
page travels with another one. Templates are broadcast up to BROADCAST_BYTES and joined by host beyond.

The content is the page's main region: an article or main element where there is one, else the deepest
element that holds nearly all text of the varying slots. Constant nodes are left out; in an article only strong ones,
since some articles may share a line or a passage, and an article of which COPY or more
is constant is kept whole: the host has copies of one article. Menus, page headers, footers, sidebars, forms, scripts and
styles are left out by element and role. Names of classes decide only outside of articles, for elements that hold
no article; inside of one, only a block that is named just as adverts or reader comments is left out.
Pages of a host without a template are read by elements, roles and names alone.

Text inside a block has its white space as one space and is trimmed; blocks are joined by one space.
Character references are decoded. Null and empty html, and pages without a content, give an empty text.
Rows that repeat are extracted alike; a null or odd url makes the host empty, which is a host of its own. A
null page_id is allowed. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.functions.dom import Node, parse
from cellforge.llm.common import arrow_batches, stored

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("script style noscript template iframe svg canvas object embed audio video head title meta link nav footer aside form button select input textarea dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget"
    " cookie cookies consent notice notices popup modal overlay newsletter subscribe signup comment comments respond reply replies disqus share sharing social related recommended pagination pager toolbar skip".split()
)
#: Compound names that hold one of these begin or end with it: `site-header`, `comment_list`.
_SPLIT = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")
#: Inside of an article, blocks that have just such a name are left out: adverts and reader comments.
OWN_NAMES = frozenset("ad ads advert adverts advertisement sponsored comments comment-list reader-comments".split())
CONTAINERS = frozenset("div section ul ol dl figure".split())
#: Share of the varying text that the content region must hold.
REGION = 0.8
#: Share of an article's text that is constant where pages have copies of one article.
COPY = 0.5
#: Pages of a host that its template is learnt from, those of them that all others are aligned with, and other pages that must have a constant text.
REFERENCES, BASES, SUPPORT = 8, 3, 2
#: Cells of a table of two rows of children that is kept whole.
TABLE = 1 << 22
#: Templates are broadcast up to so many bytes in all.
BROADCAST_BYTES = 32 << 20


def boilerplate(n: Node, inside: bool, holds: set[int]) -> bool:
    """Whether an element isn't content; inside: of an article or main element; holds: ids of elements that hold one."""
    if n.tag in SKIP:
        return True
    if n.tag == "header":  # a page's, not an article's own
        return not inside
    if n.tag in ("html", "body", "article", "main", "[document]") or not n.raw:
        return False
    if n.get("role").lower() in ROLES or "hidden" in n.attrs or n.get("aria-hidden") == "true":
        return True
    names = [*n.classes, n.get("id")]
    if inside:
        return n.tag in CONTAINERS and any(name.lower() in OWN_NAMES for name in names)
    if id(n) in holds:
        return False
    for name in names:
        parts = [p.lower() for p in _SPLIT.split(name) if p]
        if parts and (parts[0] in NAMES or parts[-1] in NAMES):
            return True
    return False


def is_region(n: Node) -> bool:
    return n.tag in ("article", "main") or (bool(n.raw) and n.get("role") in ("main", "article"))


class Block:
    """A node of the block tree: its label, own text in runs between child blocks, and child blocks."""

    __slots__ = ("label", "items", "kids", "region", "node", "constant", "strong", "size")

    def __init__(self, node: Node) -> None:
        self.node = node
        self.label = " ".join((node.tag, *sorted(node.classes))) if node.raw else node.tag
        self.region = is_region(node)
        self.items: list[str | Block] = []
        self.kids: list[Block] = []
        self.constant = self.strong = False
        self.size = 0

    def text(self) -> str:
        """The own text; runs hold no line end."""
        return "\n".join(i for i in self.items if isinstance(i, str))


def blocks(node: Node) -> Block:
    """The block tree of an element, without boilerplate; text of inline elements belongs to the block around."""
    holds = {id(p) for n in node.walk() if is_region(n) for p in n.ancestors()}
    top = Block(node)
    work: list[tuple[Block, Node, Iterator, bool]] = [(top, node, iter(node.kids), top.region)]
    run: list[str] = []

    def end(b: Block) -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            b.items.append(text)
            b.size += len(text)

    while work:
        b, n, kids, inside = work[-1]
        for k in kids:
            if isinstance(k, str):
                run.append(k)
            elif k.tag in INLINE:
                if k.tag == "br":
                    run.append(" ")
                elif not boilerplate(k, inside, holds):
                    work.append((b, k, iter(k.kids), inside))
                    break
            else:
                end(b)
                if not boilerplate(k, inside, holds):
                    child = Block(k)
                    b.items.append(child)
                    b.kids.append(child)
                    work.append((child, k, iter(k.kids), inside or child.region))
                    break
        else:
            work.pop()
            if n is b.node:
                end(b)
                if work:
                    work[-1][0].size += b.size
    return top


class Tree:
    """Labels, own texts, parents and children of nodes in page order; of names the place of each node in the whole tree."""

    def __init__(self, labels: list[str], texts: list[str], parents: list[int], names: list[int] | None = None) -> None:
        self.labels, self.texts, self.parents = labels, texts, parents
        self.names = list(range(len(labels))) if names is None else names
        self.kids: list[list[int]] = [[] for _ in labels]
        for i, p in enumerate(parents):
            if p >= 0:
                self.kids[p].append(i)

    @classmethod
    def of(cls, top: Block) -> tuple[Tree, list[Block]]:
        nodes, parents, work = [], [], [(top, -1)]
        while work:
            b, p = work.pop()
            work += [(k, len(nodes)) for k in reversed(b.kids)]
            nodes.append(b)
            parents.append(p)
        return cls([b.label for b in nodes], [b.text() for b in nodes], parents), nodes

    def marks(self) -> set[tuple[str, str]]:
        return {m for m in zip(self.labels, self.texts, strict=True) if m[1]}

    def only(self, wanted: Callable[[int], bool]) -> Tree:
        """The tree of the wanted nodes and their ancestors."""
        kept = [False] * len(self.labels)
        for i in range(len(kept) - 1, -1, -1):
            kept[i] = kept[i] or wanted(i)
            if kept[i] and self.parents[i] >= 0:
                kept[self.parents[i]] = True
        at = np.cumsum(kept) - 1
        own = [i for i, k in enumerate(kept) if k]
        return Tree([self.labels[i] for i in own], [self.texts[i] for i in own], [int(at[self.parents[i]]) if self.parents[i] >= 0 else -1 for i in own], [self.names[i] for i in own])

    def sharing(self, marks: set[tuple[str, str]]) -> Tree:
        return self.only(lambda i: bool(self.texts[i]) and (self.labels[i], self.texts[i]) in marks)


Rows = Callable[[int, int, int, int], np.ndarray]


def best_pairs(n: int, m: int, rows: Rows) -> list[tuple[int, int]]:
    """Pairs in order, each index once, of the largest total weight; rows(i, i2, j, j2) gives a block of the n x m weights. Pairs of weight 0 are none."""
    out: list[tuple[int, int]] = []
    work = [(0, n, 0, m)]

    def last_row(i: int, i2: int, j: int, j2: int, back: bool) -> np.ndarray:
        """Largest weights of rows i..i2 with each prefix (or suffix) of j..j2."""
        row = np.zeros(j2 - j + 1, np.int64)
        for k in range(i2 - 1, i - 1, -1) if back else range(i, i2):
            w = rows(k, k + 1, j, j2)[0]
            w = w[::-1] if back else w
            row[1:] = np.maximum(row[1:], row[:-1] + w)
            np.maximum.accumulate(row, out=row)
        return row[::-1] if back else row

    while work:
        i, i2, j, j2 = work.pop()
        if i2 == i or j2 == j:
            continue
        if (i2 - i) * (j2 - j) > TABLE and i2 - i > 1:  # split where both halves are best
            half = (i + i2) // 2
            cut = int((last_row(i, half, j, j2, False) + last_row(half, i2, j, j2, True)).argmax())
            work += [(half, i2, j + cut, j2), (i, half, j, j + cut)]
            continue
        w = rows(i, i2, j, j2)
        t = np.zeros((i2 - i + 1, j2 - j + 1), np.int64)
        for k in range(i2 - i):
            t[k + 1, 1:] = np.maximum(t[k, 1:], t[k, :-1] + w[k])
            np.maximum.accumulate(t[k + 1], out=t[k + 1])
        a, b, own = i2 - i, j2 - j, []
        while a and b:
            if t[a, b] == t[a, b - 1]:
                b -= 1
            elif t[a, b] == t[a - 1, b]:
                a -= 1
            else:
                a, b = a - 1, b - 1
                own.append((i + a, j + b))
        out += own[::-1]
    return out


def align(x: Tree, y: Tree) -> list[tuple[int, int]]:
    """The pairs of nodes of a simple tree matching of largest weight: equal labels count one, equal texts that aren't empty two more."""
    if not x.labels or not y.labels or x.labels[0] != y.labels[0]:
        return []
    codes: dict[tuple, int] = {}
    code, full = [], []
    for t in (x, y):  # equal subtrees have equal codes; full is a subtree's weight with itself
        c, f = [0] * len(t.labels), [0] * len(t.labels)
        for i in range(len(c) - 1, -1, -1):
            c[i] = codes.setdefault((t.labels[i], t.texts[i], *(c[k] for k in t.kids[i])), len(codes))
            f[i] = 1 + 2 * bool(t.texts[i]) + sum(f[k] for k in t.kids[i])
        code.append(c)
        full.append(f)
    words: dict[str, int] = {"": 0}
    label, text = ([np.array([words.setdefault(v, len(words)) for v in vs], np.int64) for vs in both] for both in ((x.labels, y.labels), (x.texts, y.texts)))

    # pairs of inner nodes, parents first; each is met from the pair of its parents only
    todo, at = [(0, 0)], {(0, 0): 0}
    rows: list[tuple[list[tuple[int, int]], list[int], list[int]]] = []
    for a, b in todo:
        ka, kb = x.kids[a], y.kids[b]
        head = 0
        while head < min(len(ka), len(kb)) and code[0][ka[head]] == code[1][kb[head]]:
            head += 1
        tail = 0
        while tail < min(len(ka), len(kb)) - head and code[0][ka[-1 - tail]] == code[1][kb[-1 - tail]]:
            tail += 1
        same = [*zip(ka[:head], kb[:head], strict=True), *zip(ka[len(ka) - tail :], kb[len(kb) - tail :], strict=True)]
        ka, kb = ka[head : len(ka) - tail], kb[head : len(kb) - tail]
        rows.append((same, ka, kb))
        inner = [j for j in kb if y.kids[j]]
        for i in ka:
            if x.kids[i]:
                for j in inner:
                    if x.labels[i] == y.labels[j]:
                        at[i, j] = len(todo)
                        todo.append((i, j))
    weight, chosen = [0] * len(todo), [[]] * len(todo)
    for k in range(len(todo) - 1, -1, -1):
        a, b = todo[k]
        same, ka, kb = rows[k]
        ia, jb = np.array(ka, int), np.array(kb, int)
        deep: dict[int, list[tuple[int, int]]] = {}
        for i, u in enumerate(ka):
            for j, v in enumerate(kb) if x.kids[u] else ():
                if (u, v) in at:
                    deep.setdefault(i, []).append((j, weight[at[u, v]]))

        def block(i: int, i2: int, j: int, j2: int, ia=ia, jb=jb, deep=deep) -> np.ndarray:
            tx, ty = text[0][ia[i:i2], None], text[1][None, jb[j:j2]]
            w = (label[0][ia[i:i2], None] == label[1][None, jb[j:j2]]) * (1 + 2 * ((tx == ty) & (tx > 0)))
            for r in range(i, i2):
                for c, value in deep.get(r, ()):
                    if j <= c < j2:
                        w[r - i, c - j] = value
            return w

        pairs = best_pairs(len(ka), len(kb), block)
        chosen[k] = [(ka[i], kb[j]) for i, j in pairs]
        own = 1 + 2 * (bool(x.texts[a]) and x.texts[a] == y.texts[b])
        weight[k] = own + sum(full[0][i] for i, _ in same) + sum(int(block(i, i + 1, j, j + 1)[0, 0]) for i, j in pairs)

    found, work = [], [(0, 0, False)]
    while work:
        a, b, equal = work.pop()
        found.append((a, b))
        if equal:
            work += [(i, j, True) for i, j in zip(x.kids[a], y.kids[b], strict=True)]
        elif (a, b) in at:
            same, _, _ = rows[at[a, b]]
            work += [(i, j, True) for i, j in same] + [(i, j, False) for i, j in chosen[at[a, b]]]
    return found


def constants(x: Tree, y: Tree) -> list[tuple[int, int]]:
    """Nodes of x, and of y, that are aligned and have an equal text."""
    a, b = x.sharing(y.marks()), y.sharing(x.marks())
    return [(a.names[i], b.names[j]) for i, j in align(a, b) if a.texts[i] and a.texts[i] == b.texts[j]]


def learn(pages: list[str]) -> bytes | None:
    """The template of different pages of a host: constant nodes with their ancestors, once for each way that pages have them."""
    trees = [Tree.of(blocks(parse(p, bare=True)))[0] for p in pages]
    need, found = min(SUPPORT, len(trees) - 1), []
    for n, x in enumerate(trees[:BASES] if need else ()):
        times = [0] * len(x.labels)
        for k, y in enumerate(trees):
            for i, _ in constants(x, y) if k != n else ():
                times[i] += 1
        t = x.only(lambda i, times=times: times[i] >= need)
        texts = [v if times[i] >= need else "" for i, v in zip(t.names, t.texts, strict=True)]
        own = [t.labels, texts, t.parents, [times[i] == len(trees) - 1 >= SUPPORT for i in t.names]]
        if t.labels and own not in found:
            found.append(own)
    return json.dumps(found).encode() if found else None


def _mark(page: Block, template: bytes | None) -> None:
    if template is None:
        return
    tree, nodes = Tree.of(page)
    for labels, texts, parents, strong in json.loads(template):
        for i, j in constants(tree, Tree(labels, texts, parents)):
            nodes[i].constant = True
            nodes[i].strong |= strong[j]


def _all_blocks(b: Block) -> list[Block]:
    order = [b]
    for x in order:
        order += x.kids
    return order


def _spelt(b: Block, left_out: Callable[[Block], bool]) -> list[str]:
    """Block texts in page order, without those of blocks that are left out."""
    out: list[str] = []
    work: list[str | Block] = [b]
    while work:
        i = work.pop()
        if isinstance(i, str):
            out.append(i)
        else:
            work += [k for k in i.items[::-1] if not (isinstance(k, str) and left_out(i))]
    return out


def _varying(b: Block) -> dict[int, int]:
    """Characters of varying text in each block's subtree, by id."""
    sizes: dict[int, int] = {}
    for x in reversed(_all_blocks(b)):
        sizes[id(x)] = (0 if x.constant else len(x.text())) + sum(sizes[id(k)] for k in x.kids)
    return sizes


def main_text(html: str, template: bytes | None = None) -> str:
    """The main text of a page, with its host's template."""
    if not html:
        return ""
    page = blocks(parse(html, bare=True))
    _mark(page, template)
    regions, work = [], [page]
    while work:
        b = work.pop()
        if b.region and b.size:
            regions.append(b)
        else:
            work += b.kids[::-1]
    if regions:
        fixed = lambda b: b.strong
        inside = [b for r in regions for b in _all_blocks(r)]
        whole = sum(len(b.text()) for b in inside if fixed(b)) >= COPY * sum(r.size for r in regions)
        return " ".join(t for r in regions for t in _spelt(r, (lambda b: False) if whole else fixed))
    sizes = _varying(page)
    if not sizes[id(page)]:
        return ""
    here = page
    while deeper := next((k for k in here.kids if sizes[id(k)] >= REGION * sizes[id(page)] and k.kids), None):
        here = deeper
    return " ".join(_spelt(here, lambda b: b.constant))


def host(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) of each host of pages (host, html) that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [learn(list(dict.fromkeys(x for x in refs if x))) for refs in b.column("refs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(found, pa.binary())], ["host", "template"])

    of = lambda i: F.min(F.struct(F.xxhash64(F.lit(i), "html"), "html"))["html"]
    arrow_batches(pages.sparkSession, 16)
    refs = pages.where(F.length("html") > 0).groupBy("host").agg(F.array(*(of(i) for i in range(REFERENCES))).alias("refs"))
    return refs.mapInArrow(run, "host string, template binary").where("template IS NOT NULL")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(html or "", t) for html, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host())
    # read from a table, the templates are an exchange of their own, and adaptive execution can split a hot host's pages
    known = stored(templates(p), "templates")
    size = known.agg(F.coalesce(F.sum(F.length("host") + F.length("template")), F.lit(0))).first()[0]
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known
    arrow_batches(pages.sparkSession, 128)
    return p.join(known, "host", "left").select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
