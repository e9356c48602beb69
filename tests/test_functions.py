"""Grids, labels, trees, extractors and settings, without Spark."""

import random

import pytest

from cellforge.config import DEFAULTS, Settings
from cellforge.functions import grid, labels
from cellforge.functions.dom import clean_text, has_class, parse
from cellforge.operators.cells import tables_of
from cellforge.sources import extractors, pubmed, registry
from cellforge.sources.extractors import cleaned


def test_tree_repairs_what_is_left_open():
    t = parse("<table><tr><td>a<td>b<tr><th>c</th></table><p>x<b>y<p>z<div>w</div><ul><li>1<li>2<ul><li>3</ul><li>4</ul>&copy;</nope><br/>end")
    assert [len(r.elements()) for r in t.find_all("tr")] == [2, 1]
    assert [p.text() for p in t.find_all("p")] == ["xy", "z"]
    assert [li.text() for li in t.find_all("li")] == ["1", "23", "3", "4"]
    assert t.text().endswith("©end")


def test_tree_attributes_and_raw_text():
    t = parse("<a href='x>y' CLASS=\"p q\" data-n=3>k</a><script>if (a<b) '</p>'</script><title>A &amp; B</title><!-- <p>no</p> -->")
    a = t.find("a")
    assert a.get("href") == "x>y" and has_class("q")(a) and a.get("data-n") == "3"
    assert t.find("script").text() == "if (a<b) '</p>'" and t.find("title").text() == "A & B" and t.find("p") is None


@pytest.mark.parametrize("html", ["", "<", "<<<>>>", "</p>", "<table", "<td>x", "&#xZZ; &amp", "<a b='", "\x00<p>퟿"])
def test_every_input_gives_a_tree(html):
    assert parse(html).tag == "[document]"


def test_cleaned_text():
    assert clean_text(parse("<h1>Head</h1><p>one <b>two</b></p><script>x</script><p></p>")) == "Head\n\nonetwo"
    assert clean_text(parse("<div>only</div><svg>no</svg>")) == "only"


def rows_of(html, **options):
    g = grid.build(parse(html).find("table"), **options)
    return None if g is None else [[c.text if c else None for c in r] for r in g]


def test_grid_spans():
    assert rows_of("<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td>d</table>") == [["a", "b", "b"], ["a", "c", "d"]]
    g = grid.build(parse("<table><tr><td colspan=2>b<td>c</table>").find("table"))
    assert [(c.span, c.lead) for c in g[0]] == [(2, True), (2, False), (1, True)]


def test_grid_last_cell_takes_what_is_left():
    assert rows_of("<table><tr><td>a<td>b<td>c<tr><td>d<td>e</table>") == [["a", "b", "c"], ["d", "e", "e"]]


def test_grid_odd_values_and_empty_tables():
    assert rows_of("<table><tr><td colspan=NaN>a<td rowspan=x>b</table>") == [["a", "b"]]
    assert rows_of("<table></table>") is None and rows_of("<table><tr></table>") is None and grid.build(None) is None
    assert rows_of("<table><tr><td>a<br>b</table>") == [["a\nb"]]
    assert len(rows_of("<table><tr><td rowspan=99999999>a</table>")) == grid.MAX_ROWSPAN


def test_grid_may_grow_ahead_of_need():
    # two columns: a cell in the second half of an odd row adds a row, rounding half to even
    g = grid.Grid(2)
    heights = []
    for t in "abcdef":
        g.place(t)
        heights.append(g.height)
    assert heights == [1, 2, 2, 2, 3, 4]


def naive_place(cells, width):
    rows = []
    for text, down, across in cells:
        flat = [c for r in rows for c in r]
        if None in flat:
            at = flat.index(None)
            need = round(at / width + down) - len(rows) if at / width + down > len(rows) else 0
        else:
            at, need = len(flat), down
        rows += [[None] * width for _ in range(need)]
        across = min(across, width - at % width)
        for r in range(down):
            for c in range(across):
                rows[at // width + r][at % width + c] = text
    return rows


def test_grid_cursor_equals_search_from_the_start():
    rng = random.Random(0)
    for _ in range(300):
        width = rng.randrange(1, 7)
        cells = [(str(k), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 4])) for k in range(rng.randrange(1, 25))]
        g = grid.Grid(width)
        for c in cells:
            g.place(*c)
        assert [[c.text if c else None for c in r] for r in g.rows()] == naive_place(cells, width)


@pytest.mark.parametrize(
    ("names", "groups"),
    [
        (["r", "x", "y", "z", "x", "y", "z"], [(1, 3), (4, 3)]), (["x", "y", "z"], []), (["x", "y", "a", "x", "y", "b"], [(0, 2), (3, 2)]), (["x", "x"], []),
        (["EMPTY_LABEL", "v", "EMPTY_LABEL", "v"], [(0, 2), (2, 2)]), ([], []), (["a", "y", "z", "b", "y", "z", "a", "y", "z"], [(0, 3), (6, 3)]),
    ],
)
def test_repeating_groups(names, groups):
    assert labels.repeating_groups(names) == groups


PAGES = {
    "PMC": ('<div class="table-wrap"><h3>Table 2.</h3><div class="caption">Cap</div><div class="xtable">{t}</div><div class="tblwrap-foot">Foot</div></div>', (1, "2", "Table 2.", "Cap", "Foot")),
    "Plos": ("<table-wrap><label>Table 4</label><caption><title>Cap</title></caption>{t}<table-wrap-foot>Foot</table-wrap-foot></table-wrap>", (1, "4", "Table 4", "Cap", "Foot")),
    "Frontiers": ('<table-wrap id="T5"><label>TABLE 5</label><caption>Cap</caption>{t}</table-wrap>', (1, "5", "TABLE 5", "Cap", None)),
    "OUP": ('<div class="table-full-width-wrap table-modal">{t}</div><div class="table-full-width-wrap"><span class="label">Table 1</span><span class="caption">Cap</span>{t}<span class="fn">Foot</span></div>', (1, "1", "Table 1", "Cap", "Foot")),
    "ScienceDirect": ('<div class="tables"><p><span class="label">Table 3</span>. Cap</p>{t}<dl class="tblFootnote">Foot</dl></div>', (1, "3", "Table 3", ". Cap", "Foot")),
    "MDPI": ('<div id="table_body_display_x-t001" class="html-table_show"><div class="html-caption">Table 1. Cap</div>{t}<div class="html-table_foot">Foot</div></div>', (1, "1", "Table 1", "Cap", "Foot")),
    "HighWire": ('<div class="table-expansion"><span class="table-label">Table 2</span><div class="table-caption">Cap</div><table id="table-2"><tr><td>x<td>y</table></div>', (2, "2", "Table 2", "Cap", None)),
    "JournalOfCognitiveNeuroscience": ('<div class="table-wrap" content-id="T6x"><div class="caption">Table 6. Cap</div><table role="table"><tr><td>x<td>y</table><div class="fn"><p>Foot</p></div></div>', (1, "6", "Table 6. Cap", "Table 6. Cap", "Foot")),
    "Wiley": ('<div class="article-table-content" id="hbm-tbl-0003"><span class="label">TABLE 3</span>{t}</div>', (1, "3", "TABLE 3", None, None)),
    "Sage": ('<figure class="table" id="jad-1-jad2-t02"><figcaption><span class="heading">Table 2.</span> Cap</figcaption>{t}<div class="notes"><p>Foot</p></div></figure>', (1, None, "Table 2", "Cap", "Foot")),
    "AmPsych": ('<figure class="table" id="T3"><figcaption><span class="heading">TABLE 3.</span> Cap</figcaption>{t}</figure>', (1, "3", "TABLE 3", "Cap", None)),
    "OldSpringer": ('<figure id="Tab2"><span class="CaptionNumber">Table 2</span><div class="CaptionContent"><p>Cap</p></div>{t}<div class="TableFooter"><p>Foot</p></div></figure>', (1, "2", "Table 2", "Cap", "Foot")),
    "Springer": ('<div class="Table" id="Tab7"><div class="Caption">Cap</div>{t}</div>', (1, "7", "Table 7", "Cap", None)),
    "NationalAcademyOfSciences": ('<figure class="table"><div class="caption">Table 1. Cap</div>{t}</figure>', (1, "1", "Table 1", "Cap", None)),
    "TaylorAndFrancis": ('<script>tandf.tfviewerdata = {{"table-index-map": {{"T0002": 1}}, "tables": [{{"id": "T0002", "content": "<table><caption>Table 2. Cap</caption><tr><td>x<td>y</table>"}}]}};</script>', (1, "2", "Table 2", "Cap", None)),
    None: ('<h2>Table 9 of peaks</h2><div class="table-container">{t}</div>', (1, "9", "Table 9 of peaks", None, None)),
}


@pytest.mark.parametrize("source", PAGES, ids=str)
def test_extractors(source):
    page, want = PAGES[source]
    t = "<table><tr><th>x<th>y<tr><td>1<td>2</table>"
    root = cleaned(parse(f"<html><body>{page.format(t=t)}</body></html>"))
    got = list(tables_of(root, source, DEFAULTS))
    assert len(got) == 1
    if source == "Sage":
        assert (got[0][0], *got[0][2:5]) == (want[0], *want[2:])
    else:
        assert got[0][:5] == want
    assert got[0][5] == 2


def test_generic_extractor_leaves_out_navigation():
    nav = "<table class='nav'><tr><td><a>m</a><tr><td><a>n</a></table>"
    assert not list(extractors.generic(parse(f"<body>{nav}</body>")))
    assert len(list(extractors.generic(parse(f"<body>{nav}<table><tr><td>1<tr><td>2</table></body>")))) == 1


def test_table_links():
    page = parse('<a href="/a/T1.expansion.html">View popup</a><a href="/article/x/tables/2">Full size table</a><a href="/article/x/tables/2">again</a><a href="/other">Table of contents</a>')
    assert extractors.table_links(page) == ["/a/T1.expansion.html", "/article/x/tables/2"]


def test_registry():
    names = [p.name for p in registry.publishers()]
    assert names == sorted(names) and len(names) == 15 and set(names) == set(extractors.EXTRACTORS)
    own = registry.from_json('{"name": "N", "identifiers": ["a+"], "entities": {"&x;": "y"}, "delay": 2}', "Stem")
    assert own.name == "Stem" and own.entities["&x;"] == "y" and own.delay == 2
    assert registry.from_json('{"entities": null}', "S").entities == registry.ENTITIES


def test_settings():
    s = Settings().with_changes(careful=False)
    assert not s.careful and s.reset("careful").careful and s.reset() == Settings()
    with pytest.raises(ValueError):
        s.with_changes(nothing=1)


def test_metadata():
    xml = "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><JournalIssue><PubDate><Year>1999</Year></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>An <i>odd</i> title</ArticleTitle><ArticleDate><Year>2001</Year></ArticleDate></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId>one</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"
    m = pubmed.metadata_of(xml)
    assert (m["pmid"], m["year"], m["title"], m["authors"], m["citation"], m["doi"]) == ("7", 2001, "An odd title", None, "one", None)
    assert pubmed.metadata_of("<x/>") is None and pubmed.metadata_of("not xml") is None and pubmed.metadata_of(None) is None
    assert pubmed.query("Brain Res", "fmri") == "(Brain+Res[Journal]+journal+article[pt]+fmri)"


def test_html_of_a_deep_element():
    from cellforge.sources.extractors import outer_html

    assert outer_html(parse("<table><tr><td a=1>x &lt; y<br>z</table>").find("table")) == "<table><tr><td a=1>x &lt; y<br></br>z</td></tr></table>"
    deep = outer_html(parse("<table><tr><td>" + "<b>" * 5000 + "x").find("table"))
    assert deep.count("<b>") == 5000


def test_grid_of_a_cell_that_spans_everything():
    g = grid.build(parse("<table><tr><td rowspan=65534 colspan=1000>a<tr><td>b</table>").find("table"))
    assert len(g) * len(g[0]) <= grid.MAX_POSITIONS + 1000 and g[0][0].text == "a"


def test_main_part():
    from cellforge.functions.dom import main_part, readable_text

    body = "".join(f"<p>Paragraph {i}, with many words, of the article that is read here.</p>" for i in range(5))
    page = f"<body><div class=sidebar><p>Short promo, with words that are long enough to count here.</p></div><div id=content><h2>Head</h2>{body}</div><div class=comments><p>first comment, also long enough to count for something</p></div></body>"
    assert main_part(parse(page)).get("id") == "content"
    assert readable_text(parse(page)).startswith("Head\n\nParagraph 0") and "promo" not in readable_text(parse(page)) and "comment" not in readable_text(parse(page))
    assert readable_text(parse("<p>short</p>")) == "short" and main_part(parse("")) is None


def test_own_address_and_scripted_tables():
    assert extractors.own_address(parse('<meta property="og:url" content="http://b"><meta name="citation_public_url" content="http://a">')) == "http://a"
    assert extractors.own_address(parse('<meta name="dc.Identifier" content="x"><meta name="citation_public_url" content="">')) is None
    assert extractors.expands_by_script(parse("<p>View <b>popup</b></p>")) and extractors.expands_by_script(parse("<i class='TABLE-EXPAND-INLINE'>")) and not extractors.expands_by_script(parse("<p>table</p>"))


def test_references_without_a_semicolon_stay_in_the_main_part():
    from cellforge.functions.dom import readable_text

    assert readable_text(parse("<title>t</title><article><h1>a&amp;&amp; b&amp</h1><p>&ampx; &copy &lt;p&gt; &amp;amp &#65 &eacute;</p></article>")) == "a&& b&amp\n\n&ampx; &copy <p> &amp A é"
    assert parse("<h1>b&amp</h1>", bare=True).text() == "b&"


def test_references_without_a_semicolon_stay_in_readable_text(spark):
    from cellforge.functions.text import readable

    pages = spark.createDataFrame([(1, "<h1>a&amp;&amp; b&amp</h1><p>c &lt;d&gt;</p>"), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in pages.select("page_id", readable("html").alias("text")).collect()} == {1: "a&& b&amp\n\nc <d>", 2: None}


def test_comments_and_scripts_part_no_text_of_a_paragraph(spark):
    from cellforge.functions.text import readable, readable_main

    pages = spark.createDataFrame([(1, "<h1>a <!-- b --> c</h1><p>d<script>e</script> f <!----><style>g</style>h <b> i </b><!-- j --> k</p><p>l </b><!-- m --> n</p>")], "page_id long, html string")
    want = "a  c\n\nd f hik\n\nln"
    assert [tuple(r) for r in pages.select(readable("html"), readable_main("html")).collect()] == [(want, want)]
