"""From pages to the store's relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.config import DEFAULTS, Settings
from cellforge.functions import text as T
from cellforge.operators import cells, records, relational
from cellforge.sources.readers import materialised
from cellforge.sources.registry import Publisher, publishers


def screened(pages: DataFrame, known: list[Publisher] | None = None, force: bool = False) -> DataFrame:
    """pages (doc_id, html) with valid, source and the reason why a page is left out (null: it isn't)."""
    p = pages.withColumn("valid", F.coalesce(T.is_valid_page(), F.lit(False))).withColumn("source", T.identify("html", known, "Default" if force else None))
    reason = F.when(F.col("html").isNull(), "unreadable").when(~F.col("valid"), "blocked").when(F.col("source").isNull(), "unknown source")
    return p.withColumn("reason", reason)


def parsed(pages: DataFrame, settings: Settings = DEFAULTS, known: list[Publisher] | None = None, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(screened pages, tables, records). Only pages that stay go to Python, with their text's odd characters decoded."""
    gates = screened(pages, known, force)
    kept = gates.where("reason IS NULL").withColumn("html", T.decode_by_source("html", "source"))
    tables = cells.extract(kept.select("doc_id", "html", "source"), settings)
    return gates, tables, records.records(tables, settings)


def with_counts(tables: DataFrame, found: DataFrame) -> DataFrame:
    """Tables that have a record, with n_activations."""
    return tables.join(found.groupBy("doc_id", "table_ix").agg(F.count("*").alias("n_activations")), ["doc_id", "table_ix"])


def articles(pages: DataFrame, metadata: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """The articles relation of pages (doc_id, html, source): text and space from the page, the rest from metadata (pmid, ...)."""
    text = T.readable_main("html") if settings.use_readability else T.readable("html")
    return with_metadata(pages.select(F.col("doc_id").alias("id"), text.alias("text"), F.col("source").alias("publisher")), metadata)


def with_metadata(body: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Articles of body (id, text, publisher): the space by the text, and metadata (pmid, ...) by the id."""
    body = body.withColumn("space", T.guess_space("text"))
    now = [F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at")]
    if metadata is None:
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("title", "string"), ("journal", "string"), ("doi", "string"), ("year", "int"), ("authors", "string"), ("abstract", "string"), ("citation", "string"))]
        return body.select("*", *empty, *now)
    m = metadata.select(F.col("pmid").cast("long").alias("id"), "title", "journal", "doi", "year", "authors", "abstract", "citation")
    return body.join(m, "id", "left").select("*", *now)


def repository_links(pages: DataFrame) -> DataFrame:
    """(article_id, type, neurovault_id, url) of each page's links to the image repository, each once."""
    return links_in(pages.select("doc_id", T.links("html").alias("links")))


def links_in(found: DataFrame) -> DataFrame:
    """As `repository_links`, of pages' links (doc_id, links)."""
    each = found.select("doc_id", F.explode("links").alias("url")).withColumn("l", T.collection_link("url")).where("l IS NOT NULL")
    return each.select(F.col("doc_id").alias("article_id"), "l.type", F.col("l.id").alias("neurovault_id"), "url").distinct()


def best_pages(pages: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """One page for each key: that with most records, then tables (pages: key, path; tables: path, n_activations)."""
    scored = tables.groupBy("path").agg(F.sum("n_activations").alias("n_records"), F.count("*").alias("n_tables"))
    all_pages = pages.join(scored, "path", "left").select(*pages.columns, F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.lit(False).alias("missing"))
    return relational.best(all_pages, key, relational.quality("n_records", "n_tables", "missing"), "path")


def linked_tables(pages: DataFrame, linked: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Tables of the pages that pages (doc_id, html, source, url) link to, out of those fetched (url, html)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<string>")
    def targets(html):  # noqa: ANN001, ANN202
        from cellforge.functions.dom import parse
        from cellforge.sources.extractors import table_links

        return html.map(lambda h: [] if not h else table_links(parse(h)))

    each = pages.select("doc_id", "source", F.col("url").alias("base"), F.posexplode(targets("html")).alias("k", "href"))
    wanted = each.withColumn("url", T.resolved(T.base_url(F.col("base")), F.col("href"))).where("url IS NOT NULL")
    found = wanted.join(linked.select("url", "html"), "url")
    return cells.extract(found.select("doc_id", "html", "source"), settings)


def kept_articles(found: DataFrame, tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All articles, or those with tables only."""
    return found if settings.keep_empty_documents else found.join(tables.select(F.col("doc_id").alias("id")), "id", "left_semi")


def meaningful(tables: DataFrame, found: DataFrame) -> DataFrame:
    """Tables with a record that has coordinates or names a region."""
    says = F.col("x").isNotNull() | ~F.coalesce(F.lower("region"), F.lit("")).isin("", "empty", "n/a", "none")
    return tables.join(found.where(says).select("doc_id", "table_ix"), ["doc_id", "table_ix"], "left_semi")


def with_numbers(pages: DataFrame, by_doi: DataFrame) -> DataFrame:
    """pages (html, source) with doi and pmid: told by the page, else looked up by its DOI (doi, pmid)."""
    told = pages.withColumn("_ids", T.identifiers("html", "source"))
    known = by_doi.select(F.col("doi").alias("_doi"), F.col("pmid").alias("_pmid"))
    return told.join(known, F.col("_ids.doi") == F.col("_doi"), "left").withColumn("doi", F.col("_ids.doi")).withColumn("pmid", F.coalesce("_ids.pmid", "_pmid")).drop("_ids", "_doi", "_pmid")


@dataclass(frozen=True)
class Added:
    """The store's relations after articles were added, and the pages that weren't: (path, reason)."""

    articles: DataFrame
    tables: DataFrame
    activations: DataFrame
    links: DataFrame
    missing: DataFrame

    def relations(self) -> dict[str, DataFrame]:
        return {"articles": self.articles, "tables": self.tables, "activations": self.activations, "links": self.links}


def add_articles(pages: DataFrame, stored: dict[str, DataFrame] | None = None, metadata: DataFrame | None = None, by_doi: DataFrame | None = None, settings: Settings = DEFAULTS, known: list[Publisher] | None = None, force: bool = False) -> Added:
    """Adds pages (path, html and doc_id, the number by the file's name or null) to the store's relations.

    Pages whose number is stored are left out before they are parsed, unless stored articles are to be replaced. The
    others are screened, and each is parsed once for its text, links, numbers and tables. A page without a number has that
    which it tells, or that of its DOI in by_doi (doi, pmid). Of tables of no known publisher only meaningful ones stay. Of the pages
    of a number the best one becomes the article; with `keep_empty_documents` off it needs a table. What belonged to a
    replaced article goes with it; its creation time stays.
    """
    if stored is not None and not settings.overwrite:
        pages = pages.join(stored["articles"].select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    gates = screened(pages.select("doc_id", "path", "html"), known, force)
    kept = gates.where("reason IS NULL").withColumn("html", T.decode_by_source("html", "source"))
    # all relations are made of this, so no page is parsed twice
    read = materialised(cells.contents(kept, settings))
    if by_doi is not None:
        read = read.join(by_doi.select(F.col("doi").alias("_doi"), F.col("pmid").alias("_pmid")), F.col("doi") == F.col("_doi"), "left").withColumn("pmid", F.coalesce("pmid", F.col("_pmid").cast("string"))).drop("_doi", "_pmid")
    read = read.withColumn("id", F.coalesce("doc_id", F.col("pmid").try_cast("long"))).where("id IS NOT NULL")
    # a page is known by its path from here on
    page = F.xxhash64("path").alias("doc_id")
    tables = cells.tables_in(read.select(page, "tables"))
    found = materialised(records.records(tables, settings))
    counted = with_counts(tables, found).join(read.select(page, "id", "path", "source"), "doc_id")
    own = counted.where(F.col("source").isin(*[p.name for p in known or publishers()]))
    counted = own.unionByName(meaningful(counted.join(own.select("doc_id").distinct(), "doc_id", "left_anti"), found))
    best = best_pages(read.select("id", "path", "text", "source", "links", "doi"), counted, "id").drop("n_records", "n_tables", "missing")

    stamped = F.xxhash64("path", "table_ix")
    tables = counted.join(best.select("path"), "path", "left_semi").select(stamped.alias("id"), F.col("id").alias("article_id"), "doc_id", "table_ix", "position", "number", "label", "caption", "notes", "n_activations", "input_html")
    records_of = found.join(tables.select("doc_id", "table_ix", F.col("id").alias("table_id")), ["doc_id", "table_ix"]).drop("doc_id", "table_ix")
    tables = tables.drop("doc_id", "table_ix")
    rows = with_metadata(best.select("id", "text", F.col("source").alias("publisher")), metadata)
    rows = kept_articles(rows, tables.select(F.col("article_id").alias("doc_id")), settings)
    links = links_in(best.select(F.col("id").alias("doc_id"), "links")).join(rows.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    missing = gates.where("reason IS NOT NULL").select("path", "reason")
    if stored is None:
        return Added(rows, tables, records_of, links, missing)

    # a page that tells its own number may be of a stored article too
    had = stored["articles"].select("id", F.col("created_at").alias("_created"))
    if settings.overwrite:
        rows = rows.join(had, "id", "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")
    else:
        rows = rows.join(had.select("id"), "id", "left_anti")
        tables, links = (x.join(had.select(F.col("id").alias("article_id")), "article_id", "left_anti") for x in (tables, links))
        records_of = records_of.join(tables.select(F.col("id").alias("table_id")), "table_id", "left_semi")
    gone = rows.select(F.col("id").alias("article_id"))
    old_tables = stored["tables"].join(gone, "article_id", "left_anti")
    merged = lambda old, new: old.unionByName(new, allowMissingColumns=True)
    return Added(
        merged(stored["articles"].join(gone.select(F.col("article_id").alias("id")), "id", "left_anti"), rows), merged(old_tables, tables),
        merged(stored["activations"].join(stored["tables"].join(gone, "article_id", "left_semi").select(F.col("id").alias("table_id")), "table_id", "left_anti"), records_of),
        merged(stored["links"].join(gone, "article_id", "left_anti"), links), missing,
    )
