"""Readers and writers of pages and of the store's relations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.config import Settings
from cellforge.sources.registry import ENTITIES, Publisher

RELATIONS = ("articles", "tables", "activations", "links")


def pages(spark: SparkSession, paths: str | list[str], limit: int | None = None, seed: int | None = None) -> DataFrame:
    """path, file_name, doc_id (the file's stem, null unless a number) and html of whole files.

    Files that are missing or can't be read are skipped. A limit takes random files, and only where paths is one glob.
    """
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    df = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("html"))
    df = df.withColumn("doc_id", F.regexp_extract("file_name", r"^(.*)\.[^.]*$", 1).try_cast("long"))
    return df.orderBy(F.rand(seed)).limit(limit) if limit is not None and isinstance(paths, str) else df


def configs(spark: SparkSession, paths: str) -> DataFrame:
    """source (the file's stem), name, identifiers and delay of publisher configs in JSON files."""
    schema = "name string, identifiers array<string>, entities map<string,string>, delay int"
    return spark.read.schema(schema).json(paths, multiLine=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("source"), "name", "identifiers", "entities", F.coalesce("delay", F.lit(0)).alias("delay"))


def publishers_of(found: DataFrame) -> list[Publisher]:
    """Publishers of configs (a few rows), in the order in which pages are matched; own characters come before those of all."""
    rows = found.orderBy("source").collect()
    return [Publisher(r.source, tuple(r.identifiers or ()), {**(r.entities or {}), **ENTITIES}, r.delay) for r in rows]


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The finished versions of a relation, oldest first."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("v="))
    return [n for n in names if fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[1])]


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only on one machine (tests) one is made where none is named."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="cellforge-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder: what follows doesn't make it again, and plans stay small."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def relation(spark: SparkSession, settings: Settings, name: str) -> DataFrame:
    """A relation of the store: Parquet folders, or a database over JDBC."""
    if name not in RELATIONS:
        raise ValueError(f"unknown relation: {name}")
    if settings.store_adapter == "parquet":
        found = versions(spark, f"{settings.store_uri}/{name}")
        if not found:
            raise ValueError(f"the store has no relation: {name}")
        return spark.read.parquet(f"{settings.store_uri}/{name}/{found[-1]}")
    if settings.store_adapter in ("sqlite", "mysql"):
        options = {"url": settings.store_uri or f"jdbc:mysql://localhost/{settings.store_database}", "dbtable": name, "user": settings.store_user, "password": settings.store_password}
        return spark.read.format("jdbc").options(**{k: v for k, v in options.items() if v}).load()
    raise ValueError(f"unknown store adapter: {settings.store_adapter}")


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated file with a header."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def save(df: DataFrame, settings: Settings, name: str) -> None:
    """Replaces a Parquet relation as a whole: a new version is written, which counts once it is finished; the one before it stays.

    Nothing is renamed or deleted before, so a crash leaves the old version, on object stores too.
    """
    spark, folder = df.sparkSession, f"{settings.store_uri}/{name}"
    done = versions(spark, folder)
    number = int(done[-1][2:12]) + 1 if done else 0
    new = f"v={number:010d}-{uuid.uuid4().hex}"  # two writers at once don't share a folder; the greater name counts
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{folder}/{new}")
    for old in done[:-1]:
        fs, at = _fs(spark, f"{folder}/{old}")
        fs.delete(at, True)


def get_url(url: str, retries: int = 5, timeout: float = 10.0) -> str | None:
    """A page by HTTP, whatever its status says, asked for again with growing waits; None if it never comes."""
    import time
    import urllib.error
    import urllib.request

    for k in range(retries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.read().decode("utf-8", "replace")
        except OSError:
            time.sleep(2**k)
    return None
