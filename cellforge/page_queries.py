"""Queries over pages as publishers write them: one for each publisher, and for what pages say besides their tables.

All pages are derived from the driver's tables; each docstring says how. Importing this module registers them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.config import DEFAULTS
from cellforge.functions import text as T
from cellforge.operators import cells, features, headers, records
from cellforge.plans import export, ingest, retrieval
from cellforge.queries import POINTS, READABLE_SQL, VALID, _relations, html_tables, points, query, read, tr
from cellforge.sources import pubmed, readers
from cellforge.sources.registry import IDENTIFIERS
from cellforge.streaming import incremental

#: What a publisher's page has: a mark that tells it, a container for each table ({n} its number, {c} caption, {f} notes, {r} rows), and
#: in SQL over n, d and g (0 or 1) what is read: position, number, label, caption, notes.
_N, _LABEL, _CAPTION, _NOTES = "CAST(n AS VARCHAR)", "'Table ' || n", "'Peaks of set ' || d", "'from ' || d"
PUBLISHED: dict[str, tuple[str, str, tuple[str, str, str, str, str]]] = {
    "AmPsych": (IDENTIFIERS["AmPsych"][0] + '">', '<figure class="table" id="T{n}"><figcaption><span class="heading">TABLE {n}.</span> {c}</figcaption><table>{r}</table><div class="notes"><p>{f}</p></div></figure>', ("g + 1", _N, "'TABLE ' || n", _CAPTION, _NOTES)),
    "Frontiers": (IDENTIFIERS["Frontiers"][0] + "/x</article-id>", '<table-wrap id="T{n}"><label>TABLE {n}</label><caption>{c}</caption><table>{r}</table><table-wrap-foot>{f}</table-wrap-foot></table-wrap>', ("g + 1", _N, "'TABLE ' || n", _CAPTION, _NOTES)),
    "HighWire": ("<i class=highwire-journal></i>", '<div class="table-expansion"><span class="table-label">Table {n}</span><div class="table-caption">{c}</div><table id="table-{n}">{r}</table><div class="table-footnotes">{f}</div></div>', ("n", _N, _LABEL, _CAPTION, _NOTES)),
    "JournalOfCognitiveNeuroscience": (f"<meta {IDENTIFIERS['JournalOfCognitiveNeuroscience'][0]}>", '<div class="table-wrap" content-id="T{n}x"><div class="caption">{c}</div><table role="table">{r}</table><div class="fn"><p>{f}</p></div></div>', ("g + 1", _N, _CAPTION, _CAPTION, _NOTES)),
    "MDPI": ("<a href='https://www.mdpi.com'>m</a>", '<div id="table_body_display_x-t00{n}" class="html-table_show"><div class="html-caption">Table {n}. {c}</div><table>{r}</table><div class="html-table_foot">{f}</div></div>', ("g + 1", _N, _LABEL, _CAPTION, _NOTES)),
    "NationalAcademyOfSciences": (IDENTIFIERS["NationalAcademyOfSciences"][0], '<figure class="table"><div class="caption">Table {n}. {c}</div><table>{r}</table><div class="fn">{f}</div></figure>', ("g + 1", _N, _LABEL, _CAPTION, _NOTES)),
    "OUP": ("<p>OUP Academic</p>", '<div class="table-full-width-wrap table-modal"><table>{r}</table></div><div class="table-full-width-wrap"><span class="label">Table {n}</span><span class="caption">{c}</span><table>{r}</table><span class="fn">{f}</span></div>', ("g + 1", _N, _LABEL, _CAPTION, _NOTES)),
    "OldSpringer": ("<title>x - Springer</title>", '<figure id="Tab{n}"><span class="CaptionNumber">Table {n}</span><div class="CaptionContent"><p>{c}</p></div><table>{r}</table><div class="TableFooter"><p>{f}</p></div></figure>', ("g + 1", _N, _LABEL, _CAPTION, _NOTES)),
    "PMC": (IDENTIFIERS["PMC"][1], '<div class="table-wrap"><h3>Table {n}.</h3><div class="caption">{c}</div><div class="xtable"><table>{r}</table></div><div class="tblwrap-foot">{f}</div></div>', ("g + 1", _N, "'Table ' || n || '.'", _CAPTION, _NOTES)),
    "Plos": (IDENTIFIERS["Plos"][0], "<table-wrap><label>Table {n}</label><caption><title>{c}</title></caption><table>{r}</table><table-wrap-foot>{f}</table-wrap-foot></table-wrap>", ("g + 1", _N, _LABEL, _CAPTION, _NOTES)),
    "Sage": ("<a href='https://journals.sagepub.com/'>s</a>", '<figure class="table" id="jad-1-jad2-t0{n}"><figcaption><span class="heading">Table {n}.</span> {c}</figcaption><table>{r}</table><div class="notes"><p>{f}</p></div></figure>', ("g + 1", _N, _LABEL, _CAPTION, _NOTES)),
    "ScienceDirect": ("<title>x - ScienceDirect</title>", '<div class="tables"><p><span class="label">Table {n}</span>. {c}</p><table>{r}</table><dl class="tblFootnote">{f}</dl></div>', ("g + 1", _N, _LABEL, "'. Peaks of set ' || d", _NOTES)),
    "Springer": (IDENTIFIERS["Springer"][0], '<div class="Table" id="Tab{n}"><div class="Caption">{c}</div><table>{r}</table><p class="footnote">{f}</p></div>', ("g + 1", _N, _LABEL, _CAPTION, _NOTES)),
    "TaylorAndFrancis": ("<p>tandf</p>", '<script>tandf.tfviewerdata = {"table-index-map": {"T000{n}": {n}}, "tables": [{"id": "T000{n}", "content": "<table><caption>Table {n}. {c}</caption>{r}<tfoot><tr><td>{f}</td></tr></tfoot></table>"}]};</script>', ("n", _N, _LABEL, _CAPTION, _NOTES)),
    "Wiley": ("<title>x - Wiley Online Library</title>", '<div class="article-table-content" id="hbm-tbl-000{n}"><span class="label">TABLE {n}</span><div header="article-table-caption">{c}</div><table>{r}</table><div class="article-section__table-footnotes">{f}</div></div>', ("g + 1", _N, "'TABLE ' || n", _CAPTION, _NOTES)),
    "Default": ("<p>of no publisher</p>", '<h2>Table {n} of peaks</h2><div class="table-container"><table>{r}</table></div>', ("g + 1", _N, "'Table ' || n || ' of peaks'", "NULL", "NULL")),
}
HEAD = "<tr><th>Region</th><th>x</th><th>y</th><th>z</th></tr>"


def filled(template: str, n: Column, caption: Column, notes: Column, rows: Column) -> Column:
    out = F.lit(template)
    for k, v in (("{n}", n), ("{c}", caption), ("{f}", notes), ("{r}", rows)):
        out = F.replace(out, F.lit(k), v)
    return out


def rows_of(each: DataFrame, row: Column, name: str) -> DataFrame:
    """doc and the rows of its table, a header and `row` of each of its rows by vec_id, as one text."""
    own = each.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("vec_id", row.alias("html")))).alias("trs"))
    return own.select("doc", F.concat(F.lit(HEAD), F.array_join(F.transform("trs", lambda t: t.html), "")).alias(name))


def published(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """doc_id and html of pages of a publisher with two tables each: points, and the same in other axes."""
    p = points(spark, sf_dir)
    area = F.concat(F.lit("area "), "label")
    first, second = rows_of(p, tr(area, *map(F.col, "xyz")), "r0"), rows_of(p, tr(area, F.col("z"), F.col("y") - 1, F.col("x") + 1), "r1")
    mark, container, _ = PUBLISHED[name]
    n, d = F.col("doc") % 7 + 1, F.col("doc").cast("string")
    part = lambda g: filled(container, (n + 10 * g).cast("string"), F.concat(F.lit("Peaks of set "), d), F.concat(F.lit("from "), d), F.col(f"r{g}"))
    return first.join(second, "doc").select(F.col("doc").alias("doc_id"), F.concat(F.lit(f"<html><head>{mark}</head><body><p>Results</p>"), part(0), F.lit("<p>and</p>"), part(1), F.lit("</body></html>")).alias("html"))


def _register(name: str) -> None:
    position, number, label, caption, notes = PUBLISHED[name][2]
    sql = f"""
WITH {POINTS.format(s=300)}, u AS (SELECT doc AS d, 0 AS g, x, y, z FROM p UNION ALL SELECT doc, 1, z, y - 1, x + 1 FROM p),
v AS (SELECT d, g, d % 7 + 1 + 10 * g AS n, count(*) AS n_records, sum(x) AS sum_x FROM u WHERE {VALID} GROUP BY d, g)
SELECT d AS doc_id, '{name}' AS source, CAST({position} AS INT) AS position, {number} AS number, {label} AS label, CAST({caption} AS VARCHAR) AS caption, CAST({notes} AS VARCHAR) AS notes, n_records, CAST(sum_x AS DOUBLE) AS sum_x FROM v
"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        gates, tables, found = ingest.parsed(published(spark, sf_dir, name), force=name == "Default")
        sums = found.groupBy("doc_id", "table_ix").agg(F.count("*").alias("n_records"), F.sum("x").alias("sum_x"))
        told = tables.select("doc_id", "table_ix", "position", "number", "label", "caption", "notes").join(sums, ["doc_id", "table_ix"]).drop("table_ix")
        return told.join(gates.select("doc_id", "source"), "doc_id")

    run.__name__ = "extract_" + "".join(f"_{c.lower()}" if c.isupper() and i and not name[i - 1].isupper() else c.lower() for i, c in enumerate(name))
    run.__doc__ = f"Pages of {name} with two tables of points each, told, extracted and read."
    query(sql)(run)


for _name in PUBLISHED:
    _register(_name)


@query(f"""
WITH {POINTS.format(s=300)}
SELECT doc AS doc_id, 'Table 4' AS label, 'Peaks' AS caption, count(*) AS n_records FROM p WHERE {VALID} GROUP BY doc
""")
def linked_table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that link to a page of their own with a table of points, and those tables."""
    rows = rows_of(points(spark, sf_dir), tr(F.concat(F.lit("area "), "label"), *map(F.col, "xyz")), "r")
    d = F.col("doc").cast("string")
    link = F.concat(F.lit('<a href="/article/'), d, F.lit('/tables/4">Full size table</a><a href="/article/'), d, F.lit('/tables/4">again</a><a href="/other">Table of contents</a>'))
    pages = rows.select(F.col("doc").alias("doc_id"), F.lit("Springer").alias("source"), F.concat(F.lit("http://h.org/article/"), d).alias("url"), link.alias("html"))
    linked = rows.select(F.concat(F.lit("http://h.org/article/"), d, F.lit("/tables/4")).alias("url"), F.concat(F.lit("<h1 class='c-article-title'>Table 4 Peaks</h1><div class='c-article-table-container'><table>"), "r", F.lit("</table></div>")).alias("html"))
    return ingest.with_counts(t := ingest.linked_tables(pages, linked), records.records(t)).select("doc_id", "label", "caption", F.col("n_activations").alias("n_records"))


@query(f"""
WITH {POINTS.format(s=300)}, v AS (SELECT *, min(vec_id) OVER (PARTITION BY doc) AS first FROM p)
SELECT doc AS doc_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CASE WHEN vec_id = first THEN 'Area' ELSE 'area ' || label END AS region FROM v WHERE {VALID}
""")
def spanned_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers under one label over three columns that speaks of coordinates, and no labels of their own."""
    p = points(spark, sf_dir)
    p = p.join(p.groupBy("doc").agg(F.min("vec_id").alias("first")), "doc")
    numbers = F.concat(*[F.concat(F.lit("<td>"), F.col(a).cast("string"), F.lit("</td>")) for a in "xyz"])
    row = F.concat(F.lit("<tr>"), F.when(F.col("vec_id") == F.col("first"), "").otherwise(F.concat(F.lit("<td>area "), F.col("label").cast("string"), F.lit("</td>"))), numbers, F.lit("</tr>"))
    pages = html_tables(p, "<tr><td rowspan=2>Area</td><td colspan=3>Talairach coordinates</td></tr>", row)
    return records.records(cells.extract(pages)).select("doc_id", "x", "y", "z", "region")


@query(f"""
WITH {POINTS.format(s=300)}
SELECT doc AS doc_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, 'area ' || label AS region FROM p WHERE {VALID}
""")
def first_column_without_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first column whose label is blank is the region; labels lose a final period, and blank ones are looked for below."""
    head = "<tr><td></td><td>X.</td><td> y . </td><td>Z</td></tr><tr><td></td><td>empty cell</td><td></td><td></td></tr>"
    pages = html_tables(points(spark, sf_dir), head, tr(F.concat(F.lit("area "), "label"), *map(F.col, "xyz")))
    return records.records(cells.extract(pages)).select("doc_id", "x", "y", "z", "region")


@query("""
WITH e AS (SELECT DISTINCT CAST(floor(vec_id / 25) AS BIGINT) AS doc FROM embeddings)
SELECT doc AS doc_id, CAST(k AS INT) AS col_ix, ['region', 'x', 'EMPTY_LABEL', 'set ' || doc][k + 1] AS label, [CAST('region' AS VARCHAR), 'x', NULL, NULL][k + 1] AS std FROM e, range(0, 4) t(k)
""")
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of four columns: told, with a period, none at all, and one that only the second row has."""
    d = F.col("doc").cast("string")
    row = F.when(F.col("vec_id") == F.col("first"), F.concat(F.lit("<tr><td>Q</td><td>R</td><td></td><td>Set "), d, F.lit(".</td></tr>"))).otherwise("")
    p = points(spark, sf_dir)
    p = p.join(p.groupBy("doc").agg(F.min("vec_id").alias("first")), "doc")
    pages = html_tables(p, "<tr><th>Region</th><th>X.</th><th></th><th> </th></tr>", row)
    return headers.columns(headers.infer(cells.extract(pages))).select("doc_id", "col_ix", "label", "std")


@query(f"""
WITH {POINTS.format(s=300)}
SELECT vec_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(vec_id % 5 = 0 AS INT) AS n_problems, vec_id % 5 <> 0 AS whole FROM p WHERE {VALID}
""")
def record_ends_at_a_bad_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every fifth row the x column has all three numbers and the y column a word: the record ends there, with what it has."""
    odd = F.col("vec_id") % 5 == 0
    x = F.when(odd, F.concat_ws(", ", "x", "y", "z")).otherwise(F.col("x").cast("string"))
    row = tr(F.concat(F.lit("v"), F.col("vec_id").cast("string")), x, F.when(odd, "bad").otherwise(F.col("y").cast("string")), F.when(odd, "9").otherwise(F.col("z").cast("string")), F.lit("end"))
    pages = html_tables(points(spark, sf_dir), "<tr><th>Region</th><th>x</th><th>y</th><th>z</th><th>Note</th></tr>", row)
    found = records.records(cells.extract(pages))
    return found.select(F.substring("region", 2, 20).cast("long").alias("vec_id"), "x", "y", "z", F.size("problems").alias("n_problems"), F.array_contains(F.map_keys("columns"), "note").alias("whole"))


@query(f"""
WITH {POINTS.format(s=300)}
SELECT 'strict' AS reading, vec_id, CAST(44 AS DOUBLE) AS x, CAST(45 AS DOUBLE) AS y, CAST(6 AS DOUBLE) AS z FROM p
UNION ALL SELECT 'lenient', vec_id, CAST(x AS DOUBLE), CAST(y AS DOUBLE), CAST(z AS DOUBLE) FROM p WHERE {VALID}
""")
def triplets_in_other_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three numbers in a column of another kind set all axes, unless only columns of coordinates are read for them."""
    row = tr(F.concat(F.lit("v"), F.col("vec_id").cast("string")), *map(F.col, "xyz"), F.lit("44, 45, 6"))
    tables = cells.extract(html_tables(points(spark, sf_dir), "<tr><th>Region</th><th>x</th><th>y</th><th>z</th><th>BA</th></tr>", row))
    of = lambda name, s: records.records(tables, s).select(F.lit(name).alias("reading"), F.substring("region", 2, 20).cast("long").alias("vec_id"), "x", "y", "z")
    return of("strict", DEFAULTS).union(of("lenient", DEFAULTS.with_changes(strict_parity=False)))


@query(f"""
WITH {POINTS.format(s=300)}
SELECT vec_id, CAST(x AS DOUBLE) AS x, CAST(vec_id % 3 = 0 AS INT) AS n_problems, 'second ' || vec_id AS size FROM p WHERE {VALID}
""")
def region_check_and_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of digits alone are noted as a problem; of two columns of one kind the later one counts."""
    v = F.col("vec_id").cast("string")
    row = tr(F.when(F.col("vec_id") % 3 == 0, v).otherwise(F.concat(F.lit("v"), v)), *map(F.col, "xyz"), F.concat(F.lit("first "), v), F.concat(F.lit("second "), v))
    found = records.records(cells.extract(html_tables(points(spark, sf_dir), "<tr><th>Region</th><th>x</th><th>y</th><th>z</th><th>Size</th><th>Voxels</th></tr>", row)))
    return found.select(F.regexp_replace("region", "v", "").cast("long").alias("vec_id"), "x", F.size("problems").alias("n_problems"), "size")


@query(f"""
WITH {POINTS.format(s=300)}
SELECT vec_id, CAST(x AS DOUBLE) AS x FROM p WHERE {VALID} AND vec_id % 4 NOT IN (1, 2)
""")
def rows_that_are_no_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a cell over two columns, and rows that repeat the header, hold no record."""
    v = F.col("vec_id").cast("string")
    wide = F.concat(F.lit("<tr><td>v"), v, F.lit("</td><td colspan=2>1</td><td>2</td></tr>"))
    head = F.concat(F.lit("<tr><td>region</td><td>x</td><td>5</td><td>z</td></tr>"))
    row = F.when(F.col("vec_id") % 4 == 1, wide).when(F.col("vec_id") % 4 == 2, head).otherwise(tr(F.concat(F.lit("v"), v), *map(F.col, "xyz")))
    found = records.records(cells.extract(html_tables(points(spark, sf_dir), HEAD, row)))
    return found.select(F.substring("region", 2, 20).cast("long").alias("vec_id"), "x")


@query(f"""
WITH {POINTS.format(s=300)}
SELECT doc AS doc_id, count(*) + 1 AS n_rows, 2 AS n_cols, 2 * (count(*) + 1) AS n_cells FROM p GROUP BY doc
""")
def two_column_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two columns: the grid grows ahead of need in every second row, and a blank last row goes."""
    t = cells.extract(html_tables(points(spark, sf_dir).where(F.col("vec_id") >= 0), "<tr><td>a</td><td>b</td></tr>", tr(F.col("vec_id"), F.col("x"))))
    filled_cells = F.aggregate("grid", F.lit(0), lambda n, r: n + F.size(F.filter(r, lambda c: c.isNotNull())))
    return t.select("doc_id", F.size("grid").cast("long").alias("n_rows"), "n_cols", filled_cells.cast("long").alias("n_cells"))


@query("""
WITH n AS (SELECT n_nationkey, n_name, r_name, CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT i AS row_ix, 0 AS col_ix, n_name || chr(10) || r_name AS text, 1 AS span, true AS is_lead FROM n UNION ALL SELECT i, 1, CAST(n_nationkey AS VARCHAR), 2, true FROM n UNION ALL SELECT i, 2, CAST(n_nationkey AS VARCHAR), 2, false FROM n
UNION ALL SELECT 0, 0, 'Nation', 1, true UNION ALL SELECT 0, 1, 'Key', 1, true UNION ALL SELECT 0, 2, 'Other', 1, true
""")
def grid_breaks_and_last_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in rows with a line break, whose last cell takes the column that is left over."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("doc", F.lit(1).cast("long"))
    pages = html_tables(n, "<tr><th>Nation</th><th>Key</th><th>Other</th></tr>", tr(F.concat("n_name", F.lit("<br>"), "r_name"), F.col("n_nationkey")), "n_nationkey")
    return cells.cells(cells.extract(pages)).select("row_ix", "col_ix", "text", "span", "is_lead")


@query("""
WITH c AS (SELECT page_id, page_id % 6 AS k, url FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'http://h.org/a/' || page_id || '.html' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'HTTPS://k.org/' || page_id WHEN 4 THEN 'http://h.org/t/' || page_id ELSE NULL END AS link FROM c
""")
def link_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, absolute, rooted and empty links, fragments and what is no page, against the folder of the page's own address."""
    at, k = F.col("page_id").cast("string"), F.col("page_id") % 6
    href = F.when(k == 0, F.concat(at, F.lit(".html"))).when(k == 1, "#top").when(k == 2, "mailto:x@y.z").when(k == 3, F.concat(F.lit(" HTTPS://k.org/"), at, F.lit(" "))).when(k == 4, F.concat(F.lit("/t/"), at)).otherwise(" ")
    return read(spark, sf_dir, "pages").select("page_id", T.resolved(T.base_url(F.lit("http://h.org/a/page.html?q=1#f")), href).alias("link"))


@query("""
WITH p AS (SELECT page_id, page_id % 8 AS k, '10.1234/a.' || page_id AS doi FROM pages)
SELECT page_id, CASE WHEN k < 7 THEN doi END AS doi, CASE WHEN k IN (0, 3, 4) THEN CAST(page_id AS VARCHAR) WHEN k IN (1, 2, 5, 6) AND page_id % 3 = 0 THEN 'by doi ' || page_id END AS pmid FROM p
""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI and number as seven publishers write them, and numbers looked up by DOI for every third page."""
    at, k = F.col("page_id").cast("string"), F.col("page_id") % 8
    doi = F.concat(F.lit("10.1234/a."), at)
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    cases = [
        ("OUP", c('<meta name="citation_doi" content="', doi, '"><meta name="citation_pmid" content="', at, '">')), ("Plos", c("<article-id pub-id-type='doi'>", doi, "</article-id>")), ("OldSpringer", c("<p class=ArticleDOI>DOI ", doi, "</p>")),
        ("Sage", c('<meta name="publication_doi" content="https://doi.org/', doi, '"><div class="core-pmid"><a href="https://pubmed/', at, '">n</a></div>')), ("MDPI", c('<meta name="dc.identifier" content="', doi, '"><a href="http://www.ncbi.nlm.nih.gov/sites/entrez/', at, '">p</a>')),
        ("ScienceDirect", c('<div id="article-identifier-links"><a href="https://doi.org/', doi, '">d</a></div>')), ("JournalOfCognitiveNeuroscience", c('<meta name="dc.Identifier" scheme="doi" content="', doi, '">')), (None, c("<p>", doi)),
    ]
    source, html = F.lit(None).cast("string"), F.lit("")
    for i, (name, part) in enumerate(cases):
        source, html = F.when(k == i, F.lit(name)).otherwise(source), F.when(k == i, part).otherwise(html)
    pages = read(spark, sf_dir, "pages").select("page_id", source.alias("source"), html.alias("html"))
    known = read(spark, sf_dir, "pages").where("page_id % 3 = 0").select(F.concat(F.lit("10.1234/a."), F.col("page_id").cast("string")).alias("doi"), F.concat(F.lit("by doi "), F.col("page_id").cast("string")).alias("pmid"))
    return ingest.with_numbers(pages, known).select("page_id", "doi", "pmid")


@query("""
WITH g AS (SELECT page_id, page_id % 4 AS k, f.force FROM pages, (VALUES (false), (true)) f(force))
SELECT page_id, force, CASE WHEN k IN (0, 1) THEN 'MDPI' WHEN force THEN 'Default' END AS source, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'blocked' WHEN 2 THEN CASE WHEN force THEN NULL ELSE 'unknown source' END ELSE 'unreadable' END AS reason FROM g
""")
def page_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a publisher, blocked ones, of no publisher and unreadable ones: why they are left out, and with a forced publisher."""
    k = F.col("page_id") % 4
    html = F.when(k == 0, "<p>www.mdpi.com</p>").when(k == 1, "<p>www.mdpi.com</p>403 Forbidden").when(k == 2, "<p>nobody</p>")
    pages = read(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    one = lambda force: ingest.screened(pages, force=force).select("page_id", F.lit(force).alias("force"), "source", "reason")
    return one(False).union(one(True))


@query(f"""
WITH {POINTS.format(s=300)}
SELECT doc AS doc_id, 'Table 1' AS label, count(*) AS n_records FROM p WHERE {VALID} GROUP BY doc
""")
def tables_among_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of no publisher with a menu, a table of one row and a table of points: only the last one is a table of the article."""
    pages = html_tables(points(spark, sf_dir), HEAD, tr(F.concat(F.lit("area "), "label"), *map(F.col, "xyz")))
    before = '<body><table class="nav"><tr><td><a>m</a></td></tr><tr><td><a>n</a></td></tr></table><div><table><tr><td>one row</td></tr></table></div><div>'
    pages = pages.select("doc_id", F.concat(F.lit(before), F.regexp_extract("html", "(?s)(<table>.*</table>)", 1), F.lit("</div></body>")).alias("html"))
    _, tables, found = ingest.parsed(pages, force=True)
    return ingest.with_counts(tables, found).select("doc_id", "label", F.col("n_activations").alias("n_records"))


@query(f"""
WITH {POINTS.format(s=300)}
SELECT doc AS doc_id, CAST(1 AS INT) AS position, 'Table 1' AS label, count(*) AS n_records FROM p WHERE {VALID} GROUP BY doc
""")
def hinted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose tables have no container: those whose header speaks of coordinates, or that hold three numbers in a row, are the article's."""
    pages = html_tables(points(spark, sf_dir), "<tr><th>Name</th><th>MNI coordinates</th></tr>", tr(F.concat(F.lit("v"), F.col("vec_id").cast("string")), F.concat_ws(", ", "x", "y", "z")))
    plain = "<table><tr><th>Group</th><th>Age</th></tr><tr><td>a</td><td>31</td></tr></table><table role=presentation><tr><th>MNI</th></tr></table>"
    pages = pages.select("doc_id", F.lit("JournalOfCognitiveNeuroscience").alias("source"), F.concat(F.lit(plain), "html").alias("html"))
    t = cells.extract(pages)
    return ingest.with_counts(t, records.records(t)).select("doc_id", "position", "label", F.col("n_activations").alias("n_records"))


@query("""
WITH l AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN ['/a/T1.expansion.html', '/article/' || page_id || '/tables/2'] WHEN 1 THEN ['/highwire/markup/' || page_id || '/expansion'] ELSE CAST([] AS VARCHAR[]) END AS ls FROM pages)
SELECT page_id, array_to_string(ls, ' ') AS links FROM l
""")
def table_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to pages of tables, told by text and target or by target alone, each once."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def targets(html):  # noqa: ANN001, ANN202
        from cellforge.functions.dom import parse
        from cellforge.sources.extractors import table_links

        return html.map(lambda h: " ".join(table_links(parse(h))))

    at, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    both = F.concat(F.lit('<a href="/a/T1.expansion.html">View popup</a><a href="/article/'), at, F.lit('/tables/2">Full size table</a><a href="/article/'), at, F.lit('/tables/2">View table</a><a href="/other">Table of contents</a><a href="/x/tables/9">nine</a>'))
    alone = F.concat(F.lit('<a href="/highwire/markup/'), at, F.lit('/expansion">larger</a><a href="#">table</a>'))
    return read(spark, sf_dir, "pages").select("page_id", targets(F.when(k == 0, both).when(k == 1, alone).otherwise("<a href='/about'>Table of contents</a>")).alias("links"))


@query("SELECT c_custkey AS pmid, '10/' AS doi, c_mktsegment AS authors, c_name AS title, CAST(NULL AS VARCHAR) AS journal, c_nationkey AS publication_year, 'MNI' AS coordinate_space FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def export_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata file of an export."""
    return export.relations(**_relations(spark, sf_dir))["metadata"]


@query("SELECT c_custkey AS pmid, c_name AS title, c_mktsegment AS abstract, c_name AS body FROM customer")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text file of an export that keeps empty articles."""
    return export.relations(**_relations(spark, sf_dir), skip_empty=False)["text"]


@query("SELECT 'image' AS kind, s_suppkey AS pmid, s_nationkey AS id FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'collection', s_suppkey, s_nationkey FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_suppkey % 2 = 1")
def export_repository_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two files of links to the image repository of an export."""
    files = export.relations(**_relations(spark, sf_dir))
    return files["neurovault_images"].select(F.lit("image").alias("kind"), "pmid", F.col("image_id").alias("id")).union(files["neurovault_collections"].select(F.lit("collection"), "pmid", "collection_id"))


@query("SELECT 'all' AS policy, c_custkey AS id FROM customer UNION ALL SELECT 'with tables', c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def empty_article_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that are saved, with and without those that have no table."""
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"))
    both = ingest.kept_articles(a, t).select(F.lit("all").alias("policy"), "id")
    return both.union(ingest.kept_articles(a, t, DEFAULTS.with_changes(keep_empty_documents=False)).select(F.lit("with tables"), "id"))


@query(f"""
WITH {POINTS.format(s=300)}
SELECT DISTINCT doc AS doc_id FROM p WHERE doc % 3 > 0 AND {VALID}
""")
def meaningful_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages of no publisher, tables that have a record; in every third page the coordinates are words."""
    word = F.col("doc") % 3 == 0
    row = tr(F.lit("empty"), *[F.when(word, "n/a").otherwise(F.col(a).cast("string")) for a in "xyz"])
    t = cells.extract(html_tables(points(spark, sf_dir), HEAD, row))
    return ingest.meaningful(t, records.records(t)).select("doc_id").distinct()


@query("""
WITH o AS (SELECT o_custkey, 'PMC' || min(o_orderkey) AS pmcid FROM orders GROUP BY o_custkey), f AS (SELECT c_custkey AS pmid, pmcid FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT 'preferred' AS choice, pmid, pmcid IS NOT NULL AS from_full_text FROM f UNION ALL SELECT 'only', pmid, true FROM f WHERE pmcid IS NOT NULL
UNION ALL SELECT 'not open', pmid, false FROM f WHERE pmcid IS NULL OR pmid % 2 = 0
""")
def full_text_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the number of their first order: full texts preferred, demanded, or left out where they are open."""
    pairs = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o")).select(F.col("o_custkey").alias("pmid"), F.concat(F.lit("PMC"), F.col("o").cast("string")).alias("pmcid"))
    ids = retrieval.with_full_text_ids(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pmid")), pairs)
    of = lambda name, df: df.select(F.lit(name).alias("choice"), "pmid", "from_full_text")
    rest = retrieval.by_full_text(retrieval.without_open_access(ids, pairs.where("pmid % 2 = 1")), False)
    return of("preferred", retrieval.by_full_text(ids, True)).union(of("only", retrieval.by_full_text(ids, "only"))).union(of("not open", rest))


@query("SELECT DISTINCT 'd' || c_custkey AS doi FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def dois_without_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as DOIs that no urgent order was found for."""
    doi = lambda c: F.concat(F.lit("d"), F.col(c).cast("string")).alias("doi")
    return retrieval.missing_dois(read(spark, sf_dir, "customer").select(doi("c_custkey")), read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(doi("o_custkey")))


@query("SELECT 'cached' AS state, o_orderkey AS pmid FROM orders JOIN customer ON o_orderkey = c_custkey UNION ALL SELECT 'to fetch', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders)")
def cached_or_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a cache of orders has, and those that are still to be fetched."""
    have, fetch = retrieval.cached(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pmid")), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pmid")))
    return have.select(F.lit("cached").alias("state"), "pmid").union(fetch.select(F.lit("to fetch"), "pmid"))


@query("""
SELECT c_custkey, CAST(k AS INT) AS ix, CASE k WHEN 0 THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_nationkey AS VARCHAR) END AS id, CASE k WHEN 0 THEN 'PMC' || c_custkey END AS pmcid FROM customer, range(0, 2) t(k)
""")
def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers and converted numbers in XML made from customers, read back in order."""
    v = lambda n: F.col(n).cast("string")
    xml = F.concat(F.lit("<eSearchResult><Count>2</Count><IdList><Id>"), v("c_custkey"), F.lit("</Id>\n<Id>"), v("c_nationkey"), F.lit("</Id></IdList></eSearchResult>"))
    conv = F.concat(F.lit('<pmcids status="ok"><record requested-id="'), v("c_custkey"), F.lit('" pmcid="PMC'), v("c_custkey"), F.lit('" pmid="'), v("c_custkey"), F.lit('"/><record pmid="'), v("c_nationkey"), F.lit('"/></pmcids>'))
    each = read(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml"), conv.alias("conv")).select("c_custkey", pubmed.search_ids("xml").alias("id"), pubmed.converted("conv").alias("pair")).select("c_custkey", F.posexplode(F.arrays_zip("id", "pair")).alias("ix", "a"))
    return each.select("c_custkey", "ix", F.col("a.id").alias("id"), F.col("a.pair.pmcid").alias("pmcid"))


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}') AS ws FROM documents)
SELECT doc_id, CAST(len(list_filter(ws, lambda w: w = 'the')) AS BIGINT) AS the, CAST(len(list_filter(ws, lambda w: w = 'de')) AS BIGINT) AS de, CAST(len(list_filter(ws, lambda w: w = 'und')) AS BIGINT) AS und FROM d WHERE len(ws) > 0
""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of counts for each document, for three words."""
    found = features.counts(read(spark, sf_dir, "documents"), "doc_id", "text", pattern="[a-z0-9_]{2,}")
    return features.matrix(found, "doc_id", "n", ["the", "de", "und"])


@query("""
WITH s AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}') AS ws FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)),
k AS (SELECT doc_id, list_filter(ws, lambda w: w NOT IN ('the', 'de')) AS ws FROM s),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM k)
SELECT doc_id, term, count(*) AS n FROM g GROUP BY doc_id, term
""")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words in a row, without two stop words, in labelled documents."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return features.counts(d, "doc_id", "text", ngrams=(2, 2), stop_words=["the", "de"], pattern="[a-z0-9_]{2,}")


@query("""
SELECT page_id AS id, '10/' || page_id AS doi, 2000 + page_id % 10 AS year, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id END AS title, 'words of page ' || page_id AS text FROM (SELECT page_id, page_id % 2 AS k FROM pages)
""".replace("'10/' || page_id AS doi, 2000 + page_id % 10 AS year", "CASE WHEN page_id % 2 = 0 THEN '10/' || page_id END AS doi, CAST(CASE WHEN page_id % 2 = 0 THEN 2000 + page_id % 10 END AS INT) AS year"))
def article_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of pages, with metadata for every second one."""
    at = F.col("page_id").cast("string")
    p = read(spark, sf_dir, "pages")
    pages = p.select(F.col("page_id").alias("doc_id"), F.lit("PMC").alias("source"), F.concat(F.lit("<nav>menu</nav><p>words of page "), at, F.lit("</p><script>no</script>")).alias("html"))
    none = [F.lit(None).cast("string").alias(n) for n in ("journal", "authors", "abstract", "citation")]
    meta = p.where("page_id % 2 = 0").select(at.alias("pmid"), F.concat(F.lit("T"), at).alias("title"), F.concat(F.lit("10/"), at).alias("doi"), (2000 + F.col("page_id") % 10).cast("int").alias("year"), *none)
    return ingest.articles(pages, meta).select("id", "doi", "year", "title", "text")


@query(f"""
WITH {POINTS.format(s=300)},
d AS (SELECT doc, count(*) FILTER (WHERE {VALID}) AS n FROM p GROUP BY doc),
s AS (SELECT DISTINCT doc FROM d WHERE doc % 4 = 0),
a AS (SELECT doc, n, doc IN (SELECT doc FROM s) AS stored FROM d),
m AS (SELECT 'keep' AS mode, doc, CASE WHEN stored THEN 'old' ELSE 'new' END AS state, CASE WHEN stored THEN 1 ELSE 2 END AS n_tables, CASE WHEN stored THEN 1 ELSE 2 * n END AS n_records FROM a UNION ALL SELECT 'replace', doc, 'new', 2, 2 * n FROM a)
SELECT mode, doc AS id, CASE state WHEN 'old' THEN 'Stored' ELSE 'PMC' END AS publisher, state = 'new' AS is_new, CASE state WHEN 'new' THEN 'T' || doc END AS title, CASE state WHEN 'new' THEN 'MNI' END AS space, CAST(n_tables AS BIGINT) AS n_tables, CAST(n_records AS BIGINT) AS n_records, CAST(state = 'new' AS BIGINT) AS n_links FROM m
""")
def add_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages for each number (blocked, without a table, and with two tables of points), added to a store that has every fourth number."""
    p = points(spark, sf_dir)
    rows = rows_of(p, tr(F.concat(F.lit("area "), "label"), *map(F.col, "xyz")), "r")
    d = F.col("doc").cast("string")
    text = F.concat(F.lit("<p>"), F.lit("we analysed all of our data with spm and report the coordinates of all peaks found "), d, F.lit('</p><a href="https://neurovault.org/images/'), d, F.lit('">data</a>'))
    container = PUBLISHED["PMC"][1]
    one = lambda n: filled(container, F.lit(n), F.lit("c"), F.lit("f"), F.concat("r", F.lit(f"<tr><td>{n}</td></tr>")))
    mark = F.lit(PUBLISHED["PMC"][0])
    page = lambda kind, html: rows.select(F.col("doc").alias("doc_id"), F.concat(F.lit(f"/{kind}/"), d, F.lit(".html")).alias("path"), html.alias("html"))
    pages = page("a", F.concat(mark, F.lit("<title>Redirecting</title>"), text)).union(page("b", F.concat(mark, text))).union(page("c", F.concat(mark, text, one("1"), one("2"))))
    had = rows.where("doc % 4 = 0").select(F.col("doc").alias("id"))
    empty = [F.lit(None).cast("string").alias(n) for n in ("text", "space", "title", "journal", "doi", "authors", "abstract", "citation")]
    long_ago = F.lit("2001-01-01 00:00:00").cast("timestamp")
    stored = {
        "articles": had.select("id", F.lit("Stored").alias("publisher"), *empty, F.lit(None).cast("int").alias("year"), long_ago.alias("created_at"), long_ago.alias("updated_at")),
        "tables": had.select((-F.col("id") - 1).alias("id"), F.col("id").alias("article_id"), F.lit("1").alias("number")), "activations": had.select((-F.col("id") - 1).alias("table_id"), F.lit(1.0).alias("x")),
        "links": had.limit(0).select(F.col("id").alias("article_id"), F.lit("image").alias("type"), F.lit("1").alias("neurovault_id"), F.lit("u").alias("url")),
    }
    none = [F.lit(None).cast("string").alias(n) for n in ("journal", "doi", "authors", "abstract", "citation")]
    meta = rows.select(d.alias("pmid"), F.concat(F.lit("T"), d).alias("title"), F.lit(None).cast("int").alias("year"), *none)

    def counted(mode: str, overwrite: bool) -> DataFrame:
        got = ingest.add_articles(pages, stored, meta, settings=DEFAULTS.with_changes(overwrite=overwrite))
        n = lambda df, key, name: df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
        of_tables = got.tables.select(F.col("id").alias("table_id"), "article_id")
        out = got.articles.join(n(got.tables, "article_id", "n_tables"), "id", "left").join(n(got.activations.join(of_tables, "table_id"), "article_id", "n_records"), "id", "left").join(n(got.links, "article_id", "n_links"), "id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return out.select(F.lit(mode).alias("mode"), "id", "publisher", (F.year("updated_at") > 2001).alias("is_new"), "title", "space", zero("n_tables"), zero("n_records"), zero("n_links"))

    return counted("keep", False).union(counted("replace", True))


@query("""
WITH o AS (SELECT o_custkey, 'PMC' || min(o_orderkey) AS pmcid FROM orders GROUP BY o_custkey),
c AS (SELECT c_custkey AS pmid, pmcid, 'Epilepsia' AS journal, 'http://x.org/' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '/SKIP' ELSE '' END || '/abstract' AS url FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE c_custkey >= 20 AND c_custkey % 7 > 0)
SELECT 'fetch' AS list, pmid, pmcid, replace(url, 'abstract', 'full') AS url, pmcid IS NOT NULL AS from_full_text FROM c WHERE (pmcid IS NULL OR pmid % 2 = 0) AND pmid % 5 > 0
UNION ALL SELECT 'open', NULL, pmcid, NULL, NULL FROM c WHERE pmcid IS NOT NULL AND pmid % 2 = 1
""")
def retrieval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as numbers: from 20 on, without every seventh that is on disk, open full texts listed, addresses of full texts without skipped ones."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pmid"))
    pairs = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o")).select(F.col("o_custkey").alias("pmid"), F.concat(F.lit("PMC"), F.col("o").cast("string")).alias("pmcid"))
    url = F.concat(F.lit("http://x.org/"), F.col("pmid").cast("string"), F.when(F.col("pmid") % 5 == 0, "/SKIP").otherwise(""), F.lit("/abstract"))
    got = retrieval.plan(c, pairs, c.select("pmid", F.lit("Epilepsia").alias("journal")), c.where("pmid % 7 = 0"), 20, None, pairs.where("pmid % 2 = 1"), True, c.select("pmid", url.alias("url")), ["/skip/"])
    none = lambda t: F.lit(None).cast(t)
    return got.fetch.select(F.lit("fetch").alias("list"), "pmid", "pmcid", "url", "from_full_text").union(got.open_access.select(F.lit("open"), none("long"), "pmcid", none("string"), none("boolean")))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://h.org/a/' || page_id WHEN 1 THEN 'http://h.org/b/' || page_id || '.html?x=1' WHEN 2 THEN '10.1/' || page_id END AS address, page_id % 3 = 0 AS by_script FROM pages")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that pages tell in meta tags, the first kind before others, and whether a script shows their tables."""
    at, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    tag = F.when(k == 0, F.concat(F.lit('<meta property="og:url" content="http://other"><meta name="citation_public_url" content="http://h.org/a/'), at, F.lit('">')))
    tag = tag.when(k == 1, F.concat(F.lit('<meta property="og:url" content="http://h.org/b/'), at, F.lit('.html?x=1">'))).when(k == 2, F.concat(F.lit('<meta name="dc.Identifier" content="no"><meta name="dc.Identifier" scheme="doi" content="10.1/'), at, F.lit('">'))).otherwise("")
    html = F.concat(tag, F.when(F.col("page_id") % 3 == 0, F.lit("<div class='x Table-Expand-Inline'></div>")).otherwise("<p>tables</p>"))
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), html.alias("html"), F.lit("PMC").alias("source"), F.lit("").alias("path"))
    return cells.contents(pages).select(F.col("doc_id").alias("page_id"), "address", "by_script")


@query(READABLE_SQL)
def readability_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the part of a page whose paragraphs weigh most; the pages' only paragraphs and headings are in it."""
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html", F.lit(None).cast("string").alias("source"))
    return ingest.articles(p, settings=DEFAULTS.with_changes(use_readability=True)).select(F.col("id").alias("page_id"), "text")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{readers.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tables of their regions: article_id, id and input_html, a page of a publisher with one table."""
    n = read(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    html = F.concat(F.lit("<p>OUP Academic</p><div class='table-wrap'><table>" + HEAD + "<tr><td>"), "n_name", F.lit("</td><td>"), key, F.lit("</td><td>-5</td><td>7</td></tr></table></div>"))
    return n.select(F.col("n_regionkey").cast("long").alias("article_id"), F.col("n_nationkey").cast("long").alias("id"), html.alias("input_html"))


_NATION_HTML = "'<p>OUP Academic</p><div class=''table-wrap''><table><tr><th>Region</th><th>x</th><th>y</th><th>z</th></tr><tr><td>' || n_name || '</td><td>' || n_nationkey || '</td><td>-5</td><td>7</td></tr></table></div>'"


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'tables/' || n_regionkey || '/' || n_nationkey || '.html' AS path, {_NATION_HTML} AS html FROM nation")
def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as files under the paths that tables.csv names, and read back by a glob; a file's stem is its number."""
    folder = _folder(spark, "table-files")
    export.table_files(_nation_pages(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    return readers.pages(spark, f"{folder}/tables/*/*.html").select("doc_id", F.regexp_extract("path", "(tables/.*)$", 1).alias("path"), "html")


@query("SELECT CAST(7 AS BIGINT) AS n")
def random_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit takes so many random files of a glob."""
    folder = _folder(spark, "some-files")
    export.table_files(_nation_pages(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    return readers.pages(spark, f"{folder}/tables/*/*.html", limit=7, seed=1).agg(F.count_distinct("doc_id").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'OUP' AS source, n_name AS region, CAST(n_nationkey AS DOUBLE) AS x, CAST(-5 AS DOUBLE) AS y FROM nation")
def stream_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in a folder, ingested as a stream in two runs, the second with files that were there before: records of each once."""
    folder, store = _folder(spark, "arriving"), _folder(spark, "stream-store")
    n = _nation_pages(spark, sf_dir).withColumn("article_id", F.lit(0).cast("long"))
    for part in (n.where("id % 2 = 0"), n):
        export.table_files(part, folder).write.format("noop").mode("overwrite").save()
        incremental.ingest_stream(incremental.page_stream(spark, f"{folder}/tables/0"), store, f"{store}/state").awaitTermination(300)
    found = spark.read.parquet(f"{store}/records").join(spark.read.parquet(f"{store}/pages").select("doc_id", "source"), "doc_id")
    return found.select("doc_id", "source", "region", "x", "y")


@query("SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey % 2 = 0")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation that is saved twice and read back: the second version."""
    settings = DEFAULTS.with_changes(store_uri=_folder(spark, "store"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    readers.save(c, settings, "articles")
    readers.save(readers.relation(spark, settings, "articles").where("id % 2 = 0"), settings, "articles")
    return readers.relation(spark, settings, "articles")


@query("SELECT 'stored' AS state, page_id AS pmid FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT 'failed', page_id FROM pages WHERE page_id % 3 = 2")
def page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by journal in a store: every third is there, every third is blocked and listed as failed, the others are written."""
    folder, k = _folder(spark, "pages"), F.col("page_id") % 3
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("pmid"), F.concat(F.lit("J"), (F.col("page_id") % 5).cast("string")).alias("journal"), F.when(k == 2, F.concat("html", F.lit("403 Forbidden"))).otherwise(F.col("html")).alias("html"))
    failed = retrieval.store_pages(p, folder, p.where("pmid % 3 = 0"))
    return spark.read.parquet(folder).select(F.lit("stored").alias("state"), "pmid").union(failed.select(F.lit("failed"), "pmid"))


@query("SELECT r_regionkey, r_name FROM region")
def tab_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as a tab-separated file with a header, read back."""
    folder = _folder(spark, "tsv")
    read(spark, sf_dir, "region").write.csv(folder, sep="\t", header=True)
    return readers.tsv(spark, folder, "r_regionkey int, r_name string")


@query("""
WITH a AS (SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey))
SELECT 'metadata' AS file, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM a UNION ALL SELECT 'tables', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders JOIN a ON o_custkey = c_custkey
UNION ALL SELECT 'export.json', (SELECT count(*) FROM a), (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN a ON o_custkey = c_custkey)
""")
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export written as files and read back: rows of two files, and two counts of the manifest."""
    folder = _folder(spark, "export")
    export.write(spark, folder, **_relations(spark, sf_dir))
    of = lambda name: spark.read.csv(f"{folder}/{name}.csv", header=True, escape='"').agg(F.lit(name).alias("file"), F.count("*").alias("n"), F.sum(F.col("pmid").cast("long")).alias("ids"))
    said = spark.read.schema("n_articles long, n_activations long").json(f"{folder}/export.json").select(F.lit("export.json"), "n_articles", "n_activations")
    return of("metadata").union(of("tables")).union(said)


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Bare' WHEN 1 THEN 'Own' END AS source, CASE page_id % 3 WHEN 1 THEN 'a!b' ELSE 'a&odd;b' END AS text FROM pages")
def configured_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers from JSON configs, a pattern and a mark, identify pages; one of them writes a character oddly."""
    folder = _folder(spark, "configs")
    own = [("Own", '{"name": "Some Press", "identifiers": ["press of [0-9]+"], "entities": {"&odd;": "!"}, "delay": 3}'), ("Bare", '{"name": "B", "identifiers": ["bare mark"]}')]
    rows = spark.createDataFrame(own, "name string, value string")
    for name, _ in own:  # two files
        rows.where(F.col("name") == name).select("value").coalesce(1).write.text(f"{folder}/{name}")
    found = spark.read.text(f"{folder}/*", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("source"), F.from_json("value", "name string, identifiers array<string>, entities map<string,string>, delay int").alias("c"))
    known = readers.publishers_of(found.select("source", "c.name", "c.identifiers", "c.entities", F.coalesce("c.delay", F.lit(0)).alias("delay")))
    k = F.col("page_id") % 3
    html = F.when(k == 0, "bare mark, press of 3 a&odd;b").when(k == 1, F.concat(F.lit("by press of "), F.col("page_id").cast("string"), F.lit(" a&odd;b"))).otherwise("press of none a&odd;b")
    pages = ingest.screened(read(spark, sf_dir, "pages").select("page_id", html.alias("html")), known)
    entities = {p.name: {k: v for k, v in p.entities.items() if k == "&odd;"} for p in known}
    text = F.col("html")
    for name, marks in entities.items():
        text = F.when(F.col("source") == name, T.decode_entities(F.col("html"), marks)).otherwise(text) if marks else text
    return pages.select("page_id", "source", F.regexp_extract(text, r"(a\S*b)$", 1).alias("text"))


@query("SELECT '(Brain+Res[Journal]+journal+article[pt]+fmri)' AS query")
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query of a journal's articles with a further term."""
    return spark.range(1).select(F.lit(pubmed.query("Brain Res", "fmri")).alias("query"))


@query(f"""
WITH {POINTS.format(s=300)}
SELECT vec_id, '["set ' || label || '"]' AS groups, '{{"name":"v' || vec_id || '"}}' AS extra FROM p WHERE {VALID}
""")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's groups, and its columns of no standard kind, as JSON."""
    p = points(spark, sf_dir)
    p = p.join(p.groupBy("doc", "label").agg(F.min("vec_id").alias("first")), ["doc", "label"])
    heading = F.concat(F.lit("<tr><td colspan=4>set "), F.col("label").cast("string"), F.lit("</td></tr>"))
    row = F.concat(F.when(F.col("vec_id") == F.col("first"), heading).otherwise(""), tr(F.concat(F.lit("v"), F.col("vec_id").cast("string")), *map(F.col, "xyz")))
    found = records.records(cells.extract(html_tables(p, "<tr><th>Name</th><th>x</th><th>y</th><th>z</th></tr>", row, "label,vec_id")))
    name = F.element_at("columns", "name")
    return found.select(F.substring(name, 2, 20).cast("long").alias("vec_id"), F.to_json("groups").alias("groups"), F.to_json(F.map_filter("columns", lambda k, v: k == "name")).alias("extra"))


@query(f"""
WITH {POINTS.format(s=300)}
SELECT doc AS doc_id, count(*) AS n_records FROM p WHERE doc % 2 = 0 AND {VALID} GROUP BY doc
""")
def unlabelled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a setting that leaves out tables with a column without a label: every second page has one."""
    row = F.concat(F.lit("<tr><td>area "), F.col("label").cast("string"), F.lit("</td>"), *[F.concat(F.lit("<td>"), F.col(a).cast("string"), F.lit("</td>")) for a in "xyz"], F.when(F.col("doc") % 2 == 1, "<td></td>").otherwise(F.concat(F.lit("<td>N"), F.col("vec_id").cast("string"), F.lit("</td>"))), F.lit("</tr>"))
    pages = html_tables(points(spark, sf_dir), "<tr><th>Region</th><th>x</th><th>y</th><th>z</th><th></th></tr>", row)
    found = records.records(cells.extract(pages), DEFAULTS.with_changes(exclude_unlabelled=True))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_records"))
