"""Pages that arrive over time: each micro-batch runs the batch plan on what isn't stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellforge.config import DEFAULTS, Settings
from cellforge.operators import records, relational
from cellforge.plans import ingest


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path and html of whole files as they arrive in a folder."""
    raw = spark.readStream.format("text").option("wholetext", True).schema("value string").load(folder)
    path = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1).try_cast("long").alias("doc_id"), path.alias("path"), F.col("value").alias("html"))


def ingest_stream(pages: DataFrame, store: str, checkpoint: str, settings: Settings = DEFAULTS, force: bool = False) -> StreamingQuery:
    """Writes tables and records of new documents under store; a batch that is run again replaces its own files."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        try:
            known = spark.read.parquet(f"{store}/pages").where(F.col("batch") != number).select("doc_id").distinct()
            df = relational.new_only(df, known, "doc_id")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        gates, tables, _ = ingest.parsed(df, settings, force=force)
        write = lambda name, part: part.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")
        # records come from the tables as written: pages are parsed once, and a file that changes can't give two answers
        write("tables", tables)
        write("records", records.records(spark.read.schema(tables.schema).parquet(f"{store}/tables/batch={number}"), settings))
        write("pages", gates.drop("html"))

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
