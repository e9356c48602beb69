"""Where each publisher's pages have their tables, and what they say about them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from html import escape

from cellforge.functions.dom import Node, has_class, parse

# Words and patterns that tell tables, links to tables, and what isn't an article's table.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
DROPPED = ("script", "style")
_I = re.IGNORECASE
LABEL = re.compile(r"(Table\s*\d+)\b\.?", _I)
HEADING_LABEL = re.compile(r"\btable?\s*\d+", _I)
HEADER_HINT = re.compile(r"\b(mni|talairach|coordinate|peak voxel coordinate|x\s*,\s*y\s*,\s*z)\b", _I)
TRIPLET_HINT = re.compile(r"(?<!\d)[+\-−–—]?\d{1,3}\s*[,;/|\t ]\s*[+\-−–—]?\d{1,3}\s*[,;/|\t ]\s*[+\-−–—]?\d{1,3}(?!\d)")
CONTENT_HINTS = [re.compile(p, _I) for p in (r"-?\d+\.?\d*\s*,\s*-?\d+\.?\d*\s*,\s*-?\d+\.?\d*", r"-?\d+\s+-?\d+\s+-?\d+", "MNI|Talairach|coordinates")]
STATISTICS_HINT = re.compile(r"p\s*[<>=]\s*0\.\d+|[zpt]\s*=\s*\d+\.\d+", _I)
NEURO_WORDS = ("region", "area", "activation", "volume", "voxel", "brain", "cortex", "significance", "p-value", "z-score", "t-value")
NAVIGATION_WORDS = ("menu", "navigation", "nav", "login", "search", "footer", "header")
NAVIGATION_CLASSES = ("nav", "menu", "footer", "header", "sidebar")
REJECTED = ("advertisement", "sponsored", "related articles", "journal menu", "issue contents", "navigation")
LINK_TEXT = re.compile(r"\b(table|full\s*size\s*table|view\s+(this\s+)?table|view\s+popup|view\s+inline|table\s*view|open\s+table)\b", _I)
LINK_HREF = re.compile(r"(/highwire/markup/\d+/expansion\b|/article(s)?/.+/tables/\d+(?:$|[/?#])|(?:^|/)[Tt]\d+[A-Za-z0-9_-]*\.expansion\.html(?:$|[?#])|/tables?/\d+(?:$|[/?#])|table[-_/]?(view|popup|inline|expand|expansion))", _I)
SCRIPTED = re.compile(r"\btable-expand-inline\b|\bview\s*popup\b|\bexpand(ed)?\s*table\b|\bdata-table-url\b|\bhighwire/markup/\d+/expansion\b", _I)
OWN_ADDRESS = ({"name": "citation_public_url"}, {"name": "citation_fulltext_html_url"}, {"property": "og:url"}, {"name": "dc.Identifier", "scheme": "doi"})
VIEWER_DATA = re.compile(r"tandf\.tfviewerdata\s*=\s*")


@dataclass(frozen=True)
class Hit:
    """A table element with its place on the page and what is said about it."""

    table: Node
    position: int
    number: str | None = None
    label: str | None = None
    caption: str | None = None
    notes: str | None = None


def cleaned(root: Node) -> Node:
    """root with scripts kept only where an extractor reads data from them, and without styles."""
    for n in root.find_all(*DROPPED):
        if n.tag == "style" or not VIEWER_DATA.search(n.text()):
            n.drop()
    return root


def outer_html(node: Node) -> str:
    """An element as HTML, whatever its depth."""
    out: list[str] = []
    work: list[tuple[Node | str, bool]] = [(node, False)]
    while work:
        n, ends = work.pop()
        if isinstance(n, str):
            out.append(escape(n, quote=False))
        elif ends:
            out.append(f"</{n.tag}>")
        else:
            out.append(f"<{n.tag}{n.raw.rstrip('/')}>")
            work.append((n, True))
            work += [(k, False) for k in reversed(n.kids)]
    return "".join(out)


def _text(node: Node | None) -> str | None:
    return node.text().strip() if node is not None else None


def _class(node: Node, *names: str, tags: tuple[str, ...] = ()) -> Node | None:
    return node.find(*tags, where=lambda n: any(c in n.classes for c in names))


def _like(node: Node, pattern: str, tags: tuple[str, ...] = ()) -> Node | None:
    p = re.compile(pattern, _I)
    return node.find(*tags, where=lambda n: bool(n.raw) and p.search(n.get("class")) is not None)


def _last_word(label: str | None) -> str | None:
    return label.split(" ")[-1].strip() if label else None


def _digits(text: str | None) -> str | None:
    return m[0] if text and (m := re.search(r"\d+", text)) else None


def _table(container: Node) -> Node | None:
    return container if container.tag == "table" else container.find("table")


def _split_caption(text: str | None, position: int, number: str | None = None) -> tuple[str, str, str | None]:
    """(number, label, caption) of a caption that may begin with its label."""
    label = None
    if text and (m := LABEL.match(text)):
        label, text = m[1], text[m.end() :].lstrip(". ").strip()
    number = number or _digits(label) or str(position)
    return number, label or f"Table {number}", text


# --- one function for each publisher: containers on the page, then what a container says


def _described(containers: list[Node], describe: Callable[[Node, int], dict[str, str | None]]) -> Iterator[Hit]:
    for i, c in enumerate(containers):
        if (t := _table(c)) is not None:
            yield Hit(t, i + 1, **describe(c, i + 1))


def _captioned(root: Node, containers: list[Node], text_of: Callable[[Node], str | None], number_of: Callable[[Node], str | None], notes_of: Callable[[Node], str | None]) -> Iterator[Hit]:
    def describe(c: Node, i: int) -> dict[str, str | None]:
        number, label, caption = _split_caption(text_of(c), i, number_of(c))
        return {"number": number, "label": label, "caption": caption, "notes": notes_of(c)}

    return _described(containers, describe)


def mdpi(root: Node) -> Iterator[Hit]:
    found = root.find_all("div", where=lambda n: n.get("id").startswith("table_body_display_") and "html-table_show" in n.get("class"))

    def strip(n: Node | None, sep: str = "") -> str | None:
        return n.text(sep, strip=True) if n is not None else None

    by_id = lambda c: m[1] if LABEL.match(strip(_class(c, "html-caption", tags=("div",))) or "") is None and (m := re.search(r"-t(\d+)$", c.get("id"))) else None
    return _captioned(root, found, lambda c: strip(_class(c, "html-caption", tags=("div",))), by_id, lambda c: strip(_class(c, "html-table_foot", tags=("div",)), "\n"))


def highwire(root: Node) -> Iterator[Hit]:
    """Tables of a linked expansion page; a page itself has only their labels."""
    for c in root.find_all(where=has_class("table-expansion")):
        label = _text(_class(c, "table-label"))
        number = _last_word(label)
        if (t := c.find("table", where=lambda n: re.fullmatch(r"table-\d+", n.get("id")) is not None)) is not None:
            yield Hit(t, int(_digits(t.get("id"))), number, label, _text(_class(c, "table-caption")), _text(_class(c, "table-footnotes")))


def oup(root: Node) -> Iterator[Hit]:
    found = root.find_all("div", where=lambda n: "table-full-width-wrap" in n.classes and "table-modal" not in n.classes) or root.find_all("div", where=has_class("table-wrap")) or root.find_all("table")

    def describe(c: Node, i: int) -> dict[str, str | None]:
        label = _text(_class(c, "label", tags=("span",)))
        return {"number": _last_word(label), "label": label, "caption": _text(_class(c, "caption", tags=("span",))), "notes": _text(_class(c, "fn", tags=("span",)))}

    return _described(found, describe)


def science_direct(root: Node) -> Iterator[Hit]:
    def describe(c: Node, i: int) -> dict[str, str | None]:
        label, p = _text(_class(c, "label", tags=("span",))), c.find("p")
        last = p.kids[-1] if p is not None and p.kids else None
        return {"number": _last_word(label) or _last_word(c.get("data-label")), "label": label, "caption": last.strip() if isinstance(last, str) else None, "notes": _text(_class(c, "tblFootnote"))}

    return _described(root.find_all("div", where=has_class("tables")) or root.find_all("dl", where=has_class("table")), describe)


def plos(root: Node) -> Iterator[Hit]:
    def describe(c: Node, i: int) -> dict[str, str | None]:
        label = _text(c.find("label"))
        return {"number": _last_word(label), "label": label, "caption": _text(c.find("title")), "notes": _text(c.find("table-wrap-foot"))}

    return _described(root.find_all("table-wrap"), describe)


def frontiers(root: Node) -> Iterator[Hit]:
    def describe(c: Node, i: int) -> dict[str, str | None]:
        return {"number": c.get("id")[1:], "label": _text(c.find("label")), "caption": _text(c.find("caption")), "notes": _text(c.find("table-wrap-foot"))}

    return _described(root.find_all("table-wrap", where=lambda n: re.fullmatch(r"T\d+", n.get("id")) is not None), describe)


def cognitive_neuroscience(root: Node) -> Iterator[Hit]:
    found = [c for c in root.find_all("div", where=has_class("table-wrap")) if c.find("table", where=lambda n: n.get("role") == "table")]
    if found:

        def describe(c: Node, i: int) -> dict[str, str | None]:
            caption, fn = _text(_class(c, "caption", tags=("div",))), _class(c, "fn", tags=("div",))
            m = re.search(r"T(\d+).+$", c.get("content-id"))
            return {"number": m[1] if m else None, "label": caption, "caption": caption, "notes": _text(fn.find("p")) if fn is not None else None}

        yield from _described(found, describe)
        return
    n = 0
    for t in root.find_all("table", where=lambda n: n.get("role") != "presentation"):
        header = " ".join(th.text(" ", strip=True) for th in t.find_all("th"))
        if HEADER_HINT.search(header) or TRIPLET_HINT.search(" ".join(t.text(" ", strip=True).split())):
            n += 1
            yield Hit(t, n, str(n), f"Table {n}", _text(t.find("caption")))


def wiley(root: Node) -> Iterator[Hit]:
    known = re.compile(r"(.*?)-tbl-\d+|t(bl)*\d+")
    for i, c in enumerate(root.find_all("div", where=lambda n: re.search("article-table-content|table", n.get("class")) is not None and known.fullmatch(n.get("id")) is not None)):
        if (t := _table(c)) is None:
            continue
        foot = t.find("tfoot")
        if foot is not None:
            foot.drop()
        caption = c.find("caption") or c.find("div", where=lambda n: n.get("header") == "article-table-caption")
        yield Hit(t, i + 1, m[1] if (m := re.search(r"t[bl0\-]*(\d+)$", c.get("id"))) else None, _text(_class(c, "label", tags=("span",))), _text(caption), _text(foot) or _text(_class(c, "article-section__table-footnotes", tags=("div",))))


def _figures(root: Node, ids: str, fallback: bool) -> list[Node]:
    known = re.compile(ids)
    figures = root.find_all("figure", where=has_class("table"))
    return [f for f in figures if known.fullmatch(f.get("id"))] or (figures or root.find_all("div", where=has_class("table-wrap")) if fallback else [])


def _figure_notes(c: Node) -> str | None:
    notes = _class(c, "notes", tags=("div",))
    return None if notes is None else (notes.find("p") or notes).text("\n", strip=True)


def _figure_caption(c: Node) -> str | None:
    caption = c.find("figcaption")
    return caption.text(strip=True) if caption is not None else None


def sage(root: Node) -> Iterator[Hit]:
    number = lambda c: m[1] if (m := re.search(r"-t0*(\d+)$", c.get("id"))) else None
    return _captioned(root, _figures(root, r"jad-\d+-jad\d+-t\d+", True), _figure_caption, number, _figure_notes)


def am_psych(root: Node) -> Iterator[Hit]:
    return _captioned(root, _figures(root, r"T\d+", False), _figure_caption, lambda c: c.get("id")[1:], _figure_notes)


def old_springer(root: Node) -> Iterator[Hit]:
    def describe(c: Node, i: int) -> dict[str, str | None]:
        body, foot = _class(c, "CaptionContent"), _class(c, "TableFooter")
        return {"number": c.get("id")[3:], "label": _text(_class(c, "CaptionNumber", tags=("span",))), "caption": _text(body.find("p")) if body is not None else None, "notes": _text(foot.find("p")) if foot is not None else None}

    return _described(root.find_all("figure", where=lambda n: re.fullmatch(r"Tab\d+", n.get("id")) is not None), describe)


def springer(root: Node) -> Iterator[Hit]:
    """The table of a linked table page, or the tables within an article."""
    title = _class(root, "c-article-title", "c-article-satellite-title", tags=("h1",))
    own = _class(root, "c-article-table-container", tags=("div",))
    if own is not None and (t := _table(own)) is not None:
        number, label, caption = _split_caption(_text(title), 1)
        yield Hit(t, 1, number, label, (caption or "").lstrip(": .").strip() or None, _text(_class(root, "c-article-table-footer", tags=("footer",))))
        return
    found = root.find_all("div", where=lambda n: re.search(r"\bTable\b|table-wrap", n.get("class"), _I) is not None) or root.find_all("table")

    def describe(c: Node, i: int) -> dict[str, str | None]:
        m = re.search(r"(?:tab|table)\s*0*([0-9]+)", c.get("id"), _I)
        number = m[1] if m else str(i)
        return {"number": number, "label": f"Table {number}", "caption": _text(_like(c, "caption", ("div",)) or c.find("caption")), "notes": _text(_like(c, "foot|note", ("div", "p")))}

    yield from _described(found, describe)


def taylor_and_francis(root: Node) -> Iterator[Hit]:
    """Tables within the viewer's data, a JSON value of a script; positions are those of its index, from 0."""
    for script in root.find_all("script"):
        text = script.text()
        if not (m := VIEWER_DATA.search(text)):
            continue
        try:
            data, _ = json.JSONDecoder().raw_decode(text, m.end())
        except ValueError:
            continue
        index = data.get("table-index-map") or {}
        for i, entry in enumerate(data.get("tables") or []):
            part = parse(entry.get("content") or "")
            t, key = part.find("table"), entry.get("id") or ""
            if t is None:
                continue
            number = n[1] if (n := re.search(r"T0*(\d+)", key)) else str(i + 1)
            caption = _text(part.find("caption") or _like(part, "caption") or part.find(*HEADINGS))
            head, dot, rest = (caption or "").partition(".")
            named = LABEL.match(caption or "")
            yield Hit(t, int(index.get(key, i)), number, named[1] if named else f"Table {number}", rest.strip() if dot and named else caption, _text(_like(part, "foot|note") or part.find("tfoot")))


def pmc(root: Node) -> Iterator[Hit]:
    wraps = root.find_all("div", where=has_class("table-wrap"))
    found = wraps or root.find_all("section", where=lambda n: "tw" in n.classes or "table" in n.get("class")) or root.find_all(where=has_class("tbl-box"))

    def describe(c: Node, i: int) -> dict[str, str | None]:
        label = _text(c.find("h3") or _class(c, "label", "obj_head") or c.find("h4"))
        caption = _text(_like(c, "caption"))
        notes = _text(_class(c, "tblwrap-foot") or _like(c, "foot|note"))
        return {"number": _last_word(label.rstrip(".")) if label else None, "label": label, "caption": caption, "notes": notes}

    for i, c in enumerate(found):
        inner = _class(c, "xtable", tags=("div",))
        if (t := _table(inner or c)) is not None:
            yield Hit(t, i + 1, **describe(c, i + 1))


def pnas(root: Node) -> Iterator[Hit]:
    found = root.find_all("figure", where=has_class("table")) or root.find_all("div", where=has_class("table")) or root.find_all("table")

    def text(c: Node) -> str | None:
        return _text(_class(c, "caption", tags=("div",)) or c.find("h3", "h4") or c.find("caption"))

    return _captioned(root, found, text, lambda c: None, lambda c: _text(_class(c, "fn", "footnotes") or _class(c, "section", tags=("div",))))


# --- pages of no known publisher

# Containers of tables that publishers use, in order.
_CONTAINERS: list[Callable[[Node], bool]] = [
    lambda n: n.tag == "div" and "table-full-width-wrap" in n.classes and "table-modal" not in n.classes,
    lambda n: n.tag == "div" and "table-wrap" in n.get("class"),
    lambda n: n.tag == "div" and "table-container" in n.get("class"),
    lambda n: n.tag == "div" and "tables" in n.classes,
    lambda n: n.tag == "dl" and "table" in n.classes,
    lambda n: n.tag == "div" and "table" in n.get("class") and "content" in n.get("class"),
    lambda n: n.tag == "table-wrap",
    *[lambda n, tag=tag, part=part, name=name: n.tag == tag and part in n.get(name) for tag, name, part in (("figure", "id", "table"), ("figure", "id", "tbl"), ("figure", "class", "table"), ("div", "id", "table"), ("div", "id", "tbl"), ("section", "id", "table"), ("section", "id", "tbl"))],
]


def is_navigation(table: Node) -> bool:
    text, cells = table.text().lower(), len(table.find_all("td", "th"))
    names = " ".join(table.classes).lower()
    return any(w in text for w in NAVIGATION_WORDS) or bool(cells and len(table.find_all("a")) / cells > 0.5) or any(w in names for w in NAVIGATION_CLASSES)


def _around(t: Node) -> Node:
    return t.parent if t.parent is not None else t


def _by_container(root: Node) -> list[Node]:
    nodes, rest = list(root.walk()), []
    for fits in _CONTAINERS:
        found = [n for n in nodes if fits(n)]
        if with_table := [n for n in found if n.find("table") is not None]:
            return with_table
        rest += found
    return rest


def _by_meaning(root: Node) -> list[Node]:
    found, before = [], []
    for n in root.walk():
        if n.tag in HEADINGS or n.tag == "p":
            before.append(n)
        elif n.tag == "table" and (n.find("caption") is not None or any(HEADING_LABEL.search(b.text()) for b in before[-3:]) or n.get("role") == "table"):
            found.append(_around(n))
    return found


def _by_content(root: Node) -> list[Node]:
    found = []
    for t in root.find_all("table"):
        text = t.text()
        header = " ".join(h.text() for h in t.find_all("th", "thead")).lower()
        if any(p.search(text) for p in CONTENT_HINTS) or (any(w in header for w in NEURO_WORDS) and STATISTICS_HINT.search(text)):
            found.append(_around(t))
    return found


def _any_table(root: Node) -> list[Node]:
    return [_around(t) for t in root.find_all("table") if not is_navigation(t) and len(t.find_all("tr")) >= 2]


def _metadata(c: Node, table: Node, position: int) -> dict[str, str | None]:
    """What tags within the container say, else classes, else the table's caption, else headings before it."""
    out: dict[str, str | None] = {"number": None, "label": None, "caption": None, "notes": None}

    def add(label: str | None = None, caption: str | None = None, notes: str | None = None) -> None:
        for k, v in (("label", label), ("number", _digits(label)), ("caption", caption), ("notes", notes)):
            if v:
                out[k] = v

    if c.tag in ("table-wrap", "fig"):
        add(_text(c.find("label")), _text(c.find("title", "caption")), _text(c.find("table-wrap-foot", "fig-foot")))
    if not out["label"]:
        named = _class(c, "label", tags=("span",)) or c.find("span", "div", where=lambda n: len(n.kids) == 1 and isinstance(n.kids[0], str) and re.search(r"Table\s*\d+", n.kids[0], _I) is not None)
        add(_text(named), _text(_class(c, "caption", tags=("span", "div", "p")) or _like(c, "caption|title", ("span", "div", "p"))), _text(_like(c, "fn|footnote|note", ("span", "div"))))
    if not out["caption"]:
        caption = _text(table.find("caption"))
        m = re.search(r"(Table\s*\d+)", caption or "", _I)
        add(m[1] if m else None, caption, _text(table.find("tfoot")))
    if not out["label"]:
        for k, n in enumerate(c.before()):
            if k == 5:
                break
            if n.tag in HEADINGS and HEADING_LABEL.search(n.text()):
                add(n.text().strip())
                break
        else:
            out["number"], out["label"] = str(position), f"Table {position}"
        if not out["label"]:
            out["number"], out["label"] = str(position), f"Table {position}"
    return out


def is_rejected(container: Node) -> bool:
    text = container.text().lower()
    return any(w in text for w in REJECTED)


def generic(root: Node) -> Iterator[Hit]:
    """The first way of finding containers that finds tables."""
    for way in (_by_container, _by_meaning, _by_content, _any_table):
        hits, seen = [], set()
        for c in way(root):
            t = _table(c)
            if t is None or id(t) in seen or is_rejected(c):
                continue
            seen.add(id(t))
            position = len(hits) + 1
            hits.append(Hit(t, position, **_metadata(c, t, position)))
        if hits:
            yield from hits
            return


EXTRACTORS: dict[str, Callable[[Node], Iterator[Hit]]] = {
    "AmPsych": am_psych, "Frontiers": frontiers, "HighWire": highwire, "JournalOfCognitiveNeuroscience": cognitive_neuroscience, "MDPI": mdpi, "NationalAcademyOfSciences": pnas, "OUP": oup, "OldSpringer": old_springer,
    "PMC": pmc, "Plos": plos, "Sage": sage, "ScienceDirect": science_direct, "Springer": springer, "TaylorAndFrancis": taylor_and_francis, "Wiley": wiley,
}
_DEDUPED = {None, "OUP", "JournalOfCognitiveNeuroscience", "Springer", "PMC"}


def dedups(source: str | None) -> bool:
    return source in _DEDUPED or source not in EXTRACTORS


def extract(root: Node, source: str | None) -> Iterator[Hit]:
    return EXTRACTORS.get(source or "", generic)(root)


def at(hit: Hit, position: int) -> Hit:
    return replace(hit, position=position)


def table_links(root: Node) -> list[str]:
    """Targets of links to pages that hold a table, in order, each once: by text and target, else by target alone."""
    links = [(a.get("href").strip(), a.text(" ", strip=True)) for a in root.find_all("a") if a.get("href").strip()]
    told = [h for h, t in links if LINK_TEXT.search(t) and (LINK_HREF.search(h) or LINK_TEXT.search(h))]
    return list(dict.fromkeys(told or [h for h, _ in links if LINK_HREF.search(h)]))


def expands_by_script(root: Node) -> bool:
    """Whether a page's text or classes say that a script shows its tables."""
    return bool(SCRIPTED.search(root.text(" ", strip=True))) or any(SCRIPTED.search(n.get("class")) for n in root.walk() if n.raw)


def own_address(root: Node) -> str | None:
    """What the page says its address is, by the first of the meta tags that is there."""
    metas = root.find_all("meta")
    for wanted in OWN_ADDRESS:
        if n := next((m for m in metas if m.get("content") and all(m.get(k) == v for k, v in wanted.items())), None):
            return n.get("content")
    return None


# --- identifiers on a page

DOI = re.compile(r"10\.\d{4,9}/[^\s\"'<>?#]+")


def _meta(root: Node, *names: str, **also: str) -> str | None:
    for name in names:
        n = root.find("meta", where=lambda m, name=name: m.get("name") == name and all(m.get(k) == v for k, v in also.items()))
        if n is not None and n.get("content"):
            return n.get("content").strip()
    return None


def doi(root: Node, source: str | None) -> str | None:
    """The article's DOI, from the place where the publisher puts it."""
    if source in ("Plos", "Frontiers"):
        return _text(root.find("article-id", where=lambda n: n.get("pub-id-type") == "doi"))
    if source == "ScienceDirect":
        box = root.find("div", where=lambda n: n.get("id") == "article-identifier-links")
        first = next(iter(box.elements()), None) if box is not None else None
        return first.get("href").replace("https://doi.org/", "") or None if first is not None else None
    if source == "JournalOfCognitiveNeuroscience":
        return _meta(root, "dc.Identifier", scheme="doi")
    if source == "OldSpringer":
        words = (_text(_class(root, "ArticleDOI", tags=("p",))) or "").split(" ")
        return words[1] if len(words) > 1 else None
    if source == "MDPI":
        plain = _meta(root, "dc.identifier")
        return _meta(root, "citation_doi") or (plain if plain and plain.startswith("10.") else None)
    if source in ("Sage", "TaylorAndFrancis", "AmPsych"):
        og = root.find("meta", where=lambda m: m.get("property") == "og:url")
        told = _meta(root, "publication_doi", "dc.Identifier", "citation_doi") or (og.get("content") if og is not None else "")
        return m[0] if (m := DOI.search(told)) else None
    return _meta(root, "citation_doi") if source else None


def pmid(root: Node, source: str | None) -> str | None:
    """The article's number on its page; null where only a lookup by DOI gives it."""
    if source == "MDPI":
        a = root.find("a", where=lambda n: re.search(r"ncbi\.nlm\.nih\.gov/sites/entrez/(\d+)", n.get("href")) is not None)
        return m[1] if a is not None and (m := re.search(r"/(\d+)", a.get("href"))) else None
    if source in ("Sage", "AmPsych"):
        box = _class(root, "core-pmid", tags=("div",))
        a = box.find("a") if box is not None else None
        return _digits((_text(a) or "") if source == "AmPsych" else a.get("href")) if a is not None else None
    return _meta(root, "citation_pmid") if source in ("HighWire", "OUP", "PMC", "NationalAcademyOfSciences", "TaylorAndFrancis") else None
