"""Pages to tables: the one stage of the extraction that runs Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellforge.config import DEFAULTS, Settings
from cellforge.functions import grid as grids
from cellforge.functions.dom import Node, clean_text, parse, readable_text
from cellforge.sources import extractors

CELL = "struct<text:string,span:int,lead:boolean>"
TABLE = f"doc_id long, table_ix int, position int, number string, label string, caption string, notes string, n_cols int, grid array<array<{CELL}>>, input_html string"
#: Pages of a batch that goes to a Python worker.
BATCH_ROWS = 256
_NAMES = [c.strip().split(" ")[0] for c in "doc_id, table_ix, position, number, label, caption, notes, n_cols, grid, input_html".split(",")]
_CELLS = pa.list_(pa.list_(pa.struct([("text", pa.string()), ("span", pa.int32()), ("lead", pa.bool_())])))
_TYPES = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.int32(), _CELLS, pa.string()]


def tables_of(root: Node, source: str | None, settings: Settings) -> Iterator[tuple]:
    """The tables of one page in the extractor's order, each once, without doc_id and table_ix."""
    seen = set()
    for hit in extractors.extract(root, source):
        rows = grids.build(hit.table, settings.careful, settings.ignore_bad_rows)
        if rows is None:
            continue
        cells = [[None if c is None else {"text": c.text, "span": c.span, "lead": c.lead} for c in r] for r in rows]
        if extractors.dedups(source):  # only tables that could be read count as seen
            mark = " ".join(hit.table.text(" ").split()).lower()
            if mark in seen:
                continue
            seen.add(mark)
        yield hit.position, hit.number, hit.label, hit.caption, hit.notes, len(rows[0]), cells, extractors.outer_html(hit.table) if settings.keep_html else None


def extract(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row for each table of pages (doc_id, html and, if there is one, source): a page stays in its task, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, html, source in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if html:
                    root = extractors.cleaned(parse(html))
                    rows += [(doc_id, k, *t) for k, t in enumerate(tables_of(root, source, settings))]
            cols = list(zip(*rows, strict=True)) or [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

    source = F.col("source") if "source" in pages.columns else F.lit(None).cast("string")
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return pages.select(F.col("doc_id").cast("long"), "html", source.alias("source")).mapInArrow(run, TABLE)


_ENTRY = "struct<" + ",".join(c.strip().replace(" ", ":", 1) for c in TABLE.replace("array<array<" + CELL + ">>", "@").split(",")[1:]).replace("@", f"array<array<{CELL}>>") + ">"
CONTENTS = f"doc_id long, source string, path string, text string, links array<string>, doi string, pmid string, address string, table_links array<string>, by_script boolean, tables array<{_ENTRY}>"


def contents(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All that one parse of each page (doc_id, html, source, path) gives: text, links, numbers, its address, links to tables, and tables."""
    entry = pa.struct([(n, t) for n, t in zip(_NAMES[1:], _TYPES[1:], strict=True)])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.list_(entry)]
    names = [c.strip().split(" ")[0] for c in "doc_id, source, path, text, links, doi, pmid, address, table_links, by_script, tables".split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, html, source, path in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                root = parse(html or "")
                links = [a.get("href") for a in root.find_all("a") if "href" in a.attrs]
                told = (extractors.doi(root, source), extractors.pmid(root, source), extractors.own_address(root), extractors.table_links(root), extractors.expands_by_script(root))
                found = [dict(zip(_NAMES[1:], (k, *t), strict=True)) for k, t in enumerate(tables_of(extractors.cleaned(root), source, settings))]
                # the text comes last: it takes parts of the tree away
                text = readable_text(root) if settings.use_readability else clean_text(root)
                rows.append((doc_id, source, path, text, links, *told, found))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return pages.select(F.col("doc_id").cast("long"), "html", "source", "path").mapInArrow(run, CONTENTS)


def tables_in(found: DataFrame) -> DataFrame:
    """The tables of contents, a row for each."""
    return found.select("doc_id", F.explode("tables").alias("t")).select("doc_id", "t.*")


def cells(tables: DataFrame) -> DataFrame:
    """The grid as a relation: doc_id, table_ix, row_ix, col_ix, text, span and is_lead of each filled position."""
    rows = tables.select("doc_id", "table_ix", F.posexplode("grid").alias("row_ix", "row"))
    each = rows.select("doc_id", "table_ix", "row_ix", F.posexplode("row").alias("col_ix", "c")).where("c IS NOT NULL")
    return each.select("doc_id", "table_ix", "row_ix", "col_ix", F.col("c.text").alias("text"), F.col("c.span").alias("span"), F.col("c.lead").alias("is_lead"))


def regrid(relation: DataFrame, n_cols: Column | None = None) -> DataFrame:
    """Tables (doc_id, table_ix, n_cols, grid) from a cells relation; positions without a row are empty."""
    width = n_cols if n_cols is not None else F.max("col_ix") + 1
    c = F.struct("text", "span", F.col("is_lead").alias("lead"))
    tables = relation.groupBy("doc_id", "table_ix").agg(width.cast("int").alias("n_cols"), (F.max("row_ix") + 1).alias("n_rows"), F.map_from_entries(F.collect_list(F.struct(F.struct("row_ix", "col_ix"), c))).alias("at"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    return tables.select("doc_id", "table_ix", "n_cols", F.transform(upto(F.col("n_rows")), lambda i: F.transform(upto(F.col("n_cols")), lambda j: F.try_element_at("at", F.struct(i.cast("int").alias("row_ix"), j.cast("int").alias("col_ix"))))).alias("grid"))
