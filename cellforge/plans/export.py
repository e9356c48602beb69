"""The store's relations as CSV and JSON files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellforge.operators import relational



def raw_file() -> Column:
    """Where a table's HTML is, below an export's folder."""
    return F.format_string("tables/%s/%s.html", "article_id", "id")


def exported(articles: DataFrame, tables: DataFrame, links: DataFrame, skip_empty: bool) -> DataFrame:
    return relational.with_children(articles, "id", (tables, "article_id"), (links, "article_id")) if skip_empty else articles


def metadata(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("id").alias("pmid"), "doi", "authors", "title", "journal", F.col("year").alias("publication_year"), F.col("space").alias("coordinate_space"))


def text(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("id").alias("pmid"), "title", "abstract", F.col("text").alias("body"))


def tables_of(articles: DataFrame, tables: DataFrame, table_html: bool) -> DataFrame:
    raw = raw_file() if table_html else F.lit("")
    own = tables.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return own.select(F.col("article_id").alias("pmid"), F.col("id").alias("table_id"), F.col("label").alias("table_label"), F.col("caption").alias("table_caption"), F.lit("").alias("table_foot"), F.lit(1).alias("n_header_rows"), raw.alias("table_raw_file"))


def coordinates(articles: DataFrame, tables: DataFrame, records: DataFrame) -> DataFrame:
    own = tables.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi").select(F.col("article_id").alias("pmid"), F.col("id").alias("table_id"), F.col("label").alias("table_label"))
    groups = F.array_join(F.coalesce("groups", F.array()), "///")
    return records.join(own, "table_id").select("pmid", "table_id", "table_label", "x", "y", "z", "p_value", "region", "size", "statistic", groups.alias("groups"))


def links_of(articles: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    own = links.where(F.col("type") == kind).join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return own.select(F.col("article_id").alias("pmid"), F.col("neurovault_id").alias(f"{kind}_id"))


def relations(articles: DataFrame, tables: DataFrame, records: DataFrame, links: DataFrame, skip_empty: bool = True, table_html: bool = False) -> dict[str, DataFrame]:
    """What goes to each CSV file."""
    kept = exported(articles, tables, links, skip_empty)
    return {
        "metadata": metadata(kept), "coordinates": coordinates(kept, tables, records), "tables": tables_of(kept, tables, table_html), "text": text(kept),
        "neurovault_collections": links_of(kept, links, "collection"), "neurovault_images": links_of(kept, links, "image"),
    }


#: Counts of the manifest, and the files whose rows they are.
MANIFEST = {"n_articles": "metadata", "n_activations": "coordinates", "n_tables": "tables", "n_nv_collections": "neurovault_collections", "n_nv_images": "neurovault_images"}


def manifest(files: dict[str, DataFrame]) -> DataFrame:
    """One row: when, and how many rows of each kind."""
    out = None
    for k, v in MANIFEST.items():
        part = files[v].agg(F.count("*").alias(k))
        out = part if out is None else out.join(part)  # one row each
    return out.withColumn("exported", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


def table_files(tables: DataFrame, folder: str) -> DataFrame:
    """Writes each table's HTML to tables/<article>/<table>.html under folder, the path that tables.csv names; returns table_raw_file and bytes of each.

    A task writes its own rows' files through the store's file system; a task that runs again writes the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        made = set()
        for b in batches:
            sizes = []
            for name, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = f"{root}/{name}"
                if (parent := at.rpartition("/")[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                data = html.encode()
                with fs.open_output_stream(at, compression=None) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["table_raw_file", "bytes"])

    named = tables.where("input_html IS NOT NULL AND input_html <> ''").select(raw_file().alias("table_raw_file"), "input_html")
    return named.mapInArrow(run, "table_raw_file string, bytes long")


def write(spark: SparkSession, folder: str, articles: DataFrame, tables: DataFrame, records: DataFrame, links: DataFrame, skip_empty: bool = True, table_html: bool = False) -> DataFrame:
    """Writes a folder of CSV parts for each relation, the manifest, and the tables' HTML by article; returns the manifest.

    Rows are counted while they are written, so that nothing is computed twice.
    """
    files, counts = relations(articles, tables, records, links, skip_empty, table_html), {}
    for name, df in files.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True, escape='"')
        counts[name] = seen.get["n"]
    out = spark.range(1).select(*[F.lit(counts[v]).cast("long").alias(k) for k, v in MANIFEST.items()], F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("exported"))
    out.select(F.to_json(F.struct("exported", *MANIFEST)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/export.json")
    if table_html:
        kept = exported(articles, tables, links, skip_empty).select(F.col("id").alias("article_id"))
        table_files(tables.join(kept, "article_id", "left_semi"), folder).write.mode("overwrite").csv(f"{folder}/table_files.csv", header=True)
    return out
