"""Headers, records, store operations, plans and streaming on small inputs."""

import json
import math
import os

import pytest

from cellforge.config import DEFAULTS
from cellforge.functions import text as T
from cellforge.operators import cells, features, headers, qc, records, relational
from cellforge.plans import export, ingest, retrieval
from cellforge.sources import pubmed, readers
from cellforge.streaming import incremental

TABLE = "doc_id long, table_ix int, n_cols int, grid array<array<struct<text:string,span:int,lead:boolean>>>"


def tables(spark, *htmls):
    pages = spark.createDataFrame([(i, f"<html><body><table>{h}</table></body></html>") for i, h in enumerate(htmls)], "doc_id long, html string")
    return cells.extract(pages)


def one(spark, html, settings=DEFAULTS):
    return [r.asDict() for r in records.records(tables(spark, html), settings).orderBy("row_ix", "group_ix").collect()]


HEAD = "<tr><th>Region</th><th>x</th><th>y</th><th>z</th></tr>"


def test_records_of_a_plain_table(spark):
    got = one(spark, HEAD + "<tr><td>A</td><td>−12</td><td>- 5</td><td>7.</td></tr><tr><td>B</td><td>100</td><td>1</td><td>1</td></tr><tr><td>C</td><td>0</td><td>0</td><td>1</td></tr><tr><td>D</td><td>x1</td><td>1</td><td>1</td></tr><tr><td>12</td><td>1</td><td>2</td><td>3</td></tr>")
    assert [(r["region"], r["x"], r["y"], r["z"]) for r in got] == [("A", -12.0, -5.0, 7.0), ("12", 1.0, 2.0, 3.0)]
    assert got[0]["columns"] == {"region": "A", "x": "-12.0", "y": "-5.0", "z": "7.0"} and got[1]["problems"] == ["Value in region column is not a string"]


def test_heading_rows_are_carried_down(spark):
    rows = HEAD + "<tr><td>first</td><td></td><td></td><td></td></tr><tr><td>A</td><td>1</td><td>2</td><td>3</td></tr><tr><td colspan=4>second</td></tr><tr><td>B</td><td>4</td><td>5</td><td>6</td></tr><tr><td>C</td><td colspan=2>7</td><td>8</td></tr><tr><td>D</td><td>7</td><td>8</td><td>9</td></tr>"
    assert [(r["region"], r["groups"]) for r in one(spark, rows)] == [("A", ["first"]), ("B", ["second"]), ("D", ["second"])]


def test_groups_are_unpivoted(spark):
    rows = "<tr><th rowspan=2>Region</th><th colspan=3>E1</th><th colspan=3>E2</th></tr><tr><th>x</th><th>y</th><th>z</th><th>x</th><th>y</th><th>z</th></tr><tr><td>A</td><td>1</td><td>2</td><td>3</td><td>4</td><td>oops</td><td>6</td></tr><tr><td>B</td><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td></tr>"
    assert [(r["region"], r["group_ix"], r["x"], r["groups"]) for r in one(spark, rows)] == [("A", 0, 1.0, ["E1"]), ("B", 0, 1.0, ["E1"]), ("B", 1, 4.0, ["E2"])]


def test_triplets(spark):
    rows = "<tr><th>Name</th><th>Coordinates</th><th>Note</th></tr><tr><td>A</td><td>−1, 2; 3.5</td><td>n</td></tr><tr><td>B</td><td>1, 2</td><td>44, 45, 6</td></tr>"
    assert [(r["x"], r["y"], r["z"]) for r in one(spark, rows)] == [(-1.0, 2.0, 3.5), (44.0, 45.0, 6.0)]
    # of a standard kind: only the lenient reading takes it
    rows = "<tr><th>Region</th><th>Coordinates</th><th>BA</th></tr><tr><td>A</td><td>-</td><td>44, 45, 6</td></tr>"
    assert len(one(spark, rows)) == 1 and not one(spark, rows, DEFAULTS.with_changes(strict_parity=False))


def test_triplet_in_an_axis_column_excuses_blanks_and_errors_end_a_record(spark):
    rows = HEAD + "<tr><td>A</td><td>1, 2, 3</td><td></td><td></td></tr><tr><td>B</td><td></td><td>1</td><td>2</td></tr><tr><td>C</td><td>4, 5, 6</td><td>bad</td><td>9</td></tr>"
    got = one(spark, rows)
    assert [(r["region"], r["x"], r["z"], r["problems"]) for r in got] == [("A", 1.0, 3.0, []), ("C", 4.0, 6.0, ["Value in y column is not valid"])]
    assert got[1]["columns"] == {"region": "C", "x": "4, 5, 6"} and got[1]["groups"] == []


def infer_one(spark, html):
    return headers.infer(tables(spark, html)).first()


def test_labels(spark):
    r = infer_one(spark, "<tr><td></td><td>X.</td><td>empty cell</td><td>z</td></tr><tr><td>Amygdala 1 2 3</td><td>4</td><td>5</td><td>6</td></tr>")
    assert r.labels == ["region", "x", "5", "z"]
    r = infer_one(spark, "<tr><td>only</td></tr><tr><td>1</td></tr>")
    assert r.labels == ["region"]
    r = infer_one(spark, "<tr><td rowspan=2>Area</td><td colspan=3>Talairach coordinates</td></tr><tr><td>-40</td><td>1</td><td>2</td></tr><tr><td>A</td><td>1</td><td>2</td><td>3</td></tr>")
    assert r.labels == ["area", "x", "y", "z"] and r.std == ["region", "x", "y", "z"]
    r = infer_one(spark, "<tr><td>A</td><td colspan=2>wide</td></tr><tr><td>b</td><td colspan=2>again</td></tr>")
    assert r.labels == ["a", "EMPTY_LABEL", "EMPTY_LABEL"] and [s.text for s in r.spans] == ["again"]


@pytest.mark.parametrize(
    ("names", "kinds"),
    [
        (["ba", "brodmann area", "brain region", "hemisphere", "h", "k", "area (mm3)"], ["ba", "ba", "region", "hemisphere", "hemisphere", "size", "region"]),
        (["x", "y [mm]", "z [mm]"], ["x", "y", "z"]), (["z", "x", "y", "z-score", "z"], ["statistic", "x", "y", "z", "statistic"]), (["x y z"], ["coord_triplet"]), (["co-ordinates", "cluster coordinates"], ["coord_triplet", "coord_triplet"]),
        (["t", "max z", "t value", "p value", "p-val", "other", "mni coordinate score"], ["statistic", "statistic", "statistic", "p_value", "p_value", None, "coord_triplet"]),
    ],
)
def test_kinds(spark, names, kinds):
    assert headers.with_kinds(spark.createDataFrame([(names,)], "labels array<string>")).first().std == kinds


def test_cells_and_back(spark):
    t = tables(spark, "<tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td>d")
    back = cells.regrid(cells.cells(t)).first()
    assert back.n_cols == 3 and back.grid == t.first().grid


def test_page_gates(spark):
    rows = [(1, "<title>ok</title> OUP Academic"), (2, "g-recaptcha OUP Academic"), (3, None), (4, "nothing known"), (5, "www.mdpi.com - ScienceDirect</title>")]
    pages = spark.createDataFrame(rows, "doc_id long, html string")
    got = {r.doc_id: (r.source, r.reason) for r in ingest.screened(pages).collect()}
    assert got == {1: ("OUP", None), 2: ("OUP", "blocked"), 3: (None, "unreadable"), 4: (None, "unknown source"), 5: ("MDPI", None)}
    assert {r.doc_id: r.source for r in ingest.screened(pages, force=True).collect()}[4] == "Default"


def test_text_expressions(spark):
    pad = "x" * 10 + " the analysis was carried out with "
    df = spark.createDataFrame([(pad + "spm and the results were then reported here",), (pad + "afni and the results were then reported here",), ("spm",), (pad + "mni space and all the results were then reported",)], "t string")
    assert [r[0] for r in df.select(T.guess_space("t")).collect()] == ["MNI", "TAL", "UNKNOWN", "MNI"]
    df = spark.createDataFrame([("a&minus;1&nbsp;\xa0−– Ņ", "Wiley"), ("a&minus;1", None)], "t string, s string")
    assert [r[0] for r in df.select(T.decode_by_source("t", "s")).collect()] == ["a-1  --'", "a&minus;1"]
    df = spark.createDataFrame([("http://h/a/b.html?x#y", "c.html"), ("http://h/a/", "#f"), ("http://h/a/", "mailto:x"), (None, "HTTPS://k/"), ("http://h/a/b", "../t")], "b string, h string")
    assert [r[0] for r in df.select(T.resolved(T.base_url(df.b), df.h)).collect()] == ["http://h/a/c.html", None, None, "HTTPS://k/", "http://h/t"]


def test_best_and_upsert(spark):
    c = spark.createDataFrame([(1, "b", 3, 1), (1, "a", 3, 1), (1, "c", 2, 9), (2, "z", None, None), (2, "y", 0, 0)], "k long, path string, n long, t long")
    c = c.selectExpr("*", "n IS NULL AS missing")
    assert sorted((r.k, r.path) for r in relational.best(c, "k", relational.quality("n", "t", "missing"), "path").collect()) == [(1, "a"), (2, "y")]
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k long, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k long, v string")
    assert sorted(map(tuple, relational.upsert(old, new, "k", True).collect())) == [(1, "o"), (2, "n"), (3, "n")]
    assert sorted(map(tuple, relational.upsert(old, new, "k", False).collect())) == [(1, "o"), (2, "o"), (3, "n")]


def test_up_to(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 = 0 AS ok").repartition(5)
    got = sorted(r.id for r in relational.up_to(df, "id", "ok", 10).collect())
    assert got == list(range(28))


def test_features(spark):
    d = spark.createDataFrame([(1, "Red red blue"), (2, "blue green a"), (3, None)], "id long, t string")
    c = features.counts(d, "id", "t")
    assert sorted(map(tuple, c.collect())) == [(1, "blue", 1), (1, "red", 2), (2, "blue", 1), (2, "green", 1)]
    w = {(r.id, r.term): r.weight for r in features.tf_idf(c, "id", 3).collect()}
    red, blue = 2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert w[1, "red"] == pytest.approx(red / math.hypot(red, blue))
    grams = features.counts(d, "id", "t", ngrams=(1, 2), stop_words=["blue"])
    assert {r.term for r in grams.collect()} == {"red", "red red", "green"}
    assert features.vocabulary(c, 3, max_df=0.5).count() == 2 and features.matrix(c, "id", "n", ["red", "blue"]).orderBy("id").first().red == 2


def test_quality_checks(spark):
    d = spark.createDataFrame([(0.0, 1.0), (5.0, 1.5), (10.0, None)], "x double, y double")
    assert tuple(qc.non_integer_share(d, ["x", "y"]).first()) == (0.0, 0.5)
    assert [r.n for r in qc.histogram(d, ["x"], 2).orderBy("bin").collect()] == [1, 2]


def test_export(spark, tmp_path):
    articles = spark.createDataFrame([(1, "d", "a", "t", "j", 2000, "MNI", "body", "abs"), (2, *["e"] * 4, 1, *["e"] * 3)], "id long, doi string, authors string, title string, journal string, year int, space string, text string, abstract string")
    ts = spark.createDataFrame([(10, 1, "Table 1", "c", "<table/>")], "id long, article_id long, label string, caption string, input_html string")
    rs = spark.createDataFrame([(10, 1.0, 2.0, 3.0, None, "r", None, None, None), (10, 4.0, 5.0, 6.0, None, 'q"', None, None, ["g", "h"])], "table_id long, x double, y double, z double, p_value string, region string, size string, statistic string, groups array<string>")
    ls = spark.createDataFrame([], "article_id long, type string, neurovault_id string, url string")
    m = export.write(spark, str(tmp_path / "out"), articles, ts, rs, ls, table_html=True).first()
    assert (m.n_articles, m.n_activations, m.n_tables, m.n_nv_images) == (1, 2, 1, 0)
    back = spark.read.csv(str(tmp_path / "out/coordinates.csv"), header=True, escape='"').orderBy("x").collect()
    assert [(r.pmid, r.region, r.groups) for r in back] == [("1", "r", None), ("1", 'q"', "g///h")]
    said = json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "out/export.json")).collect()))
    assert said["n_tables"] == 1 and len(said["exported"]) == 19
    assert export.relations(articles, ts, rs, ls, skip_empty=False)["metadata"].count() == 2
    named = [r.table_raw_file for r in spark.read.csv(str(tmp_path / "out/tables.csv"), header=True).collect()]
    assert named == ["tables/1/10.html"] and (tmp_path / "out" / named[0]).read_text() == "<table/>"
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out/table_files.csv"), header=True).collect()] == [(named[0], "8")]


def test_retrieval(spark):
    ids = spark.createDataFrame([(i,) for i in range(6)], "pmid long")
    pairs = spark.createDataFrame([(1, "PMC1"), (2, "PMC2")], "pmid long, pmcid string")
    both = retrieval.with_full_text_ids(ids, pairs)
    assert retrieval.by_full_text(both, "only").count() == 2 and both.count() == 6
    assert retrieval.without_open_access(both, pairs.where("pmid = 1")).count() == 5
    dois = spark.createDataFrame([("a",), ("b",)], "doi string")
    assert [r.doi for r in retrieval.missing_dois(dois, dois.where("doi = 'a'")).collect()] == ["b"]


def test_service_answers(spark):
    df = spark.createDataFrame([("<eSearchResult><IdList><Id>12</Id><Id>7</Id></IdList></eSearchResult>", '<records><record requested-id="1" pmcid="PMC9" pmid="1"/><record pmid="2"/></records>')], "xml string, conv string")
    r = df.select(pubmed.search_ids("xml").alias("ids"), pubmed.converted("conv").alias("pairs")).first()
    assert r.ids == ["12", "7"] and [tuple(p) for p in r.pairs] == [("1", "PMC9"), ("2", None)]


def test_files_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    page = f"<html>OUP Academic<div class='table-wrap'><table>{HEAD}<tr><td>A</td><td>1</td><td>2</td><td>3</td></tr></table></div></html>"
    (src / "11.html").write_text(page)
    (src / "12.html").write_text("<title>Redirecting</title>" + page)
    got = {r.doc_id: r.html for r in readers.pages(spark, str(src / "*.html")).collect()}
    assert got[11] == page and readers.pages(spark, str(src / "*.html"), limit=1, seed=1).count() == 1
    store = str(tmp_path / "store")
    for name in ("13.html", "11x.html"):
        incremental.ingest_stream(incremental.page_stream(spark, str(src)), store, str(tmp_path / "cp")).awaitTermination(60)
        (src / name).write_text(page)
    incremental.ingest_stream(incremental.page_stream(spark, str(src)), store, str(tmp_path / "cp")).awaitTermination(60)
    found = spark.read.parquet(store + "/records")
    assert sorted(r.doc_id for r in found.collect() if r.doc_id is not None) == [11, 13]
    assert os.path.isdir(store + "/pages")


def test_linked_tables_and_articles(spark):
    pages = spark.createDataFrame([(1, "Springer", "http://h/article/x", '<a href="/article/x/tables/1">Full size table</a><p>text</p><p>see <a href="https://neurovault.org/images/5">i</a></p>')], "doc_id long, source string, url string, html string")
    linked = spark.createDataFrame([("http://h/article/x/tables/1", f"<h1 class='c-article-title'>Table 1 Peaks</h1><div class='c-article-table-container'><table>{HEAD}<tr><td>A</td><td>1</td><td>2</td><td>3</td></tr></table></div>")], "url string, html string")
    t = ingest.linked_tables(pages, linked)
    assert t.first().label == "Table 1" and t.first().caption == "Peaks" and records.records(t).count() == 1
    a = ingest.articles(pages).first()
    assert a.text.startswith("text") and a.space == "UNKNOWN" and a.publisher == "Springer"
    assert tuple(ingest.repository_links(pages).first())[:3] == (1, "image", "5")


def test_identifiers_of_pages(spark):
    rows = [
        ("OUP", '<meta name="citation_doi" content="10.1093/x"><meta name="citation_pmid" content="9">'), ("Plos", "<article-id pub-id-type='doi'>10.1371/p</article-id>"), ("OldSpringer", "<p class=ArticleDOI>DOI 10.1007/s</p>"), ("Sage", '<meta name="publication_doi" content="10.1177/1234"><div class="core-pmid"><a href="https://pubmed/77">n</a></div>'),
        ("MDPI", '<meta name="dc.identifier" content="10.3390/m"><a href="http://www.ncbi.nlm.nih.gov/sites/entrez/123">p</a>'), ("ScienceDirect", '<div id="article-identifier-links"><a href="https://doi.org/10.1016/j">d</a></div>'), (None, "<p>x"),
    ]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, html string")
    got = [(r.doi, r.pmid) for r in ingest.with_numbers(pages, spark.createDataFrame([("10.1371/p", "55")], "doi string, pmid string")).orderBy("doc_id").collect()]
    assert got == [("10.1093/x", "9"), ("10.1371/p", "55"), ("10.1007/s", None), ("10.1177/1234", "77"), ("10.3390/m", "123"), ("10.1016/j", None), (None, None)]


def test_store(spark, tmp_path):
    settings = DEFAULTS.with_changes(store_uri=str(tmp_path))
    for n in (1, 2, 3):
        readers.save(spark.range(n), settings, "articles")
        assert readers.relation(spark, settings, "articles").count() == n
    folder = tmp_path / "articles"
    assert len(readers.versions(spark, str(folder))) == 2  # the one before stays
    (folder / "v=9999999999-crashed").mkdir()  # a writer that didn't finish
    assert readers.relation(spark, settings, "articles").count() == 3
    readers.save(readers.relation(spark, settings, "articles").limit(1), settings, "articles")  # from itself
    assert readers.relation(spark, settings, "articles").count() == 1
    with pytest.raises(ValueError):
        readers.relation(spark, settings, "nothing")
    with pytest.raises(ValueError):
        readers.relation(spark, settings.with_changes(store_adapter="x"), "articles")
    pages = spark.createDataFrame([(1, "J", "fine"), (2, "J", "403 Forbidden"), (3, "K", "fine")], "pmid long, journal string, html string")
    failed = retrieval.store_pages(pages, str(tmp_path / "pages"), pages.where("pmid = 3"))
    assert [r.pmid for r in failed.collect()] == [2] and spark.read.parquet(str(tmp_path / "pages")).count() == 1
    have, fetch = retrieval.cached(pages.select("pmid"), pages.where("pmid = 1"))
    assert have.count() == 1 and fetch.count() == 2


def test_up_to_with_ties_of_ranges_and_few_rows(spark):
    df = spark.range(20_000).selectExpr("id", "id % 7 < 3 AS ok").repartition(9)
    for most in (1, 100, 5_000, 50_000):
        got = sorted(r.id for r in relational.up_to(df, "id", "ok", most).collect())
        want, seen = [], 0
        for i in range(20_000):
            if seen >= most:
                break
            want.append(i)
            seen += i % 7 < 3
        assert got == want
    assert relational.up_to(df.limit(0), "id", "ok", 5).count() == 0


def test_publisher_configs_identify_pages(spark, tmp_path):
    (tmp_path / "Own.json").write_text(json.dumps({"name": "Some Press", "identifiers": ["press of \\d+"], "entities": {"&odd;": "!"}, "delay": 3}))
    (tmp_path / "Bare.json").write_text(json.dumps({"name": "B", "identifiers": ["bare mark"]}))
    known = readers.publishers_of(readers.configs(spark, str(tmp_path / "*.json")))
    assert [(k.name, k.delay) for k in known] == [("Bare", 0), ("Own", 3)] and known[1].entities["&odd;"] == "!"
    pages = spark.createDataFrame([(1, "by press of 12"), (2, "bare mark, press of 3"), (3, "press of none")], "doc_id long, html string")
    assert {r.doc_id: r.source for r in ingest.screened(pages, known).collect()} == {1: "Own", 2: "Bare", 3: None}


def test_contents_are_what_the_single_readers_give(spark):
    page = f'<meta name="citation_doi" content="10.1093/x"><meta property="og:url" content="http://h/a"><h1>Head</h1><p>one, two</p><a href="/x">l</a><a href="/article/a/tables/1">Full size table</a><div class="table-wrap"><table>{HEAD}<tr><td>A</td><td>1</td><td>2</td><td>3</td></tr></table></div>'
    pages = spark.createDataFrame([(1, page, "OUP", "/p/1"), (2, None, None, "/p/2")], "doc_id long, html string, source string, path string")
    got = {r.doc_id: r for r in cells.contents(pages).collect()}
    r = got[1]
    assert (r.text, r.links, r.doi, r.address, r.table_links, r.by_script) == ("Head\n\none, two", ["/x", "/article/a/tables/1"], "10.1093/x", "http://h/a", ["/article/a/tables/1"], False)
    assert cells.tables_in(cells.contents(pages)).collect() == cells.extract(pages).collect() and got[2].tables == [] and got[2].text == ""


def test_added_articles_take_the_place_of_stored_ones(spark):
    page = f'<meta name="ncbi_db" content="pmc"><meta name="citation_pmid" content="7"><p>text</p><div class="table-wrap"><h3>Table 1</h3><table>{HEAD}<tr><td>A</td><td>1</td><td>2</td><td>3</td></tr></table></div>'
    rows = [(None, "/a/x.html", page), (8, "/a/8.html", page), (9, "/a/9.html", "403 Forbidden"), (10, "/a/10.html", "no publisher"), (11, "/a/11.html", '<meta name="ncbi_db" content="pmc"><p>no table')]
    pages = spark.createDataFrame(rows, "doc_id long, path string, html string")
    first = ingest.add_articles(pages, settings=DEFAULTS.with_changes(keep_empty_documents=False))
    assert sorted(r.id for r in first.articles.collect()) == [7, 8] and first.tables.count() == 2 and first.activations.count() == 2
    assert sorted(tuple(r) for r in first.missing.collect()) == [("/a/10.html", "unknown source"), ("/a/9.html", "blocked")]
    had = {k: readers.materialised(v) for k, v in first.relations().items()}
    again = ingest.add_articles(pages, had)
    assert sorted(r.id for r in again.articles.collect()) == [7, 8, 11] and again.tables.count() == 2
    over = ingest.add_articles(pages, had, settings=DEFAULTS.with_changes(overwrite=True))
    assert sorted(r.id for r in over.articles.collect()) == [7, 8, 11] and over.tables.count() == over.activations.count() == 2
    old = {r.id: r for r in had["articles"].collect()}
    assert all(r.created_at == old[r.id].created_at and r.updated_at > old[r.id].updated_at for r in over.articles.collect() if r.id in old)


def test_retrieval_plan_with_a_limit(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 11)], "pmid long")
    pairs = spark.createDataFrame([(2, "PMC2"), (4, "PMC4")], "pmid long, pmcid string")
    journals = spark.createDataFrame([(1, "J")], "pmid long, journal string")
    got = retrieval.plan(ids, pairs, journals, least=2, open_access=pairs.where("pmid = 2").select("pmcid"), limit=3)
    assert sorted((r.pmid, r.journal, r.from_full_text) for r in got.fetch.collect()) == [(3, "UNKNOWN", False), (4, "UNKNOWN", True), (5, "UNKNOWN", False)]
    assert [r.pmcid for r in got.open_access.collect()] == ["PMC2"] and got.missing is None


def test_pages_by_http_whatever_the_status(monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(404 if self.path == "/no" else 200)
            self.end_headers()
            self.wfile.write(b"said " + self.path.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert readers.get_url(at + "/yes") == "said /yes" and readers.get_url(at + "/no") == "said /no"
    server.shutdown()
    monkeypatch.setattr("time.sleep", lambda s: None)
    assert readers.get_url("http://127.0.0.1:9/", retries=2, timeout=0.2) is None
