"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame with
the columns of documents (the last one: tokens); it is written as Parquet and read again for the next.

In every stage null and empty texts are texts without words or bytes, a null doc_id is a document of its own text, other
columns may be null, columns that documents doesn't have are left out, and an empty table gives an empty result. What
repeated rows and ties give is said by each stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import byte_bpe, common, near_text, positional_index, rule_quality, suffix_dedup
from cellforge.llm.common import scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is kept as good from this score on.
GOOD = 0.7
#: Bytes of a repeat that is cut (of the 50-word passages of sf0.1, 98 % are so long, and 5 % have 400 bytes), and of the strings it is found by.
REPEAT, GRAM = 250, 64


#: Tables that the operators of a stage stored and its result reads, by the tables that the pipeline runs over.
_HELD: dict[tuple[str, str], set[str]] = {}


def stage(f: Stage) -> Stage:
    """A stage that first deletes what its predecessor's operators stored: the predecessor's result has been written and is read as docs.

    Nothing is deleted where docs isn't read from files of its own.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        common.release(spark, _HELD.pop(key, set()), docs)
        before = common.made(spark)
        out = f(spark, docs, sf_dir)
        _HELD[key] = common.made(spark) - before
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fit on labels.quality, scores as good.

    Without labels, or with labels of one class, nothing tells good from bad, and all documents stay. Rows that repeat stay or go together.
    """
    model = rule_quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.rules:
        return docs.select(*COLUMNS)
    return rule_quality.score(docs.select(*COLUMNS), model).where(F.col("score") >= GOOD).select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a Jaccard similarity of 0.8 or more on five-word shingles links, that of the smallest doc_id.

    SimHash finds the closest pairs, a prefix filter all others. Rows that repeat are one document; of texts of one doc_id in a group all stay.
    Texts without words are one group. A null doc_id goes where its group has a document with an id.
    """
    return near_text.keep_one(docs.select(*COLUMNS))


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the REPEAT-byte strings that occur twice; one that consists of them stays as an empty text.

    All occurrences go, the first one too. A row that repeats is two places of each of its strings.
    """
    return suffix_dedup.cut_repeats(docs.select(*COLUMNS), REPEAT, GRAM).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item (an item of fewer words is one window).

    Rows that repeat stay or go together; with an empty benchmark all stay.
    """
    judged = positional_index.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return judged.where("NOT contaminated").select(*COLUMNS)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of the ids and of the text that they decode to; rows that repeat stay."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeats", repeats), ("decontaminate", decontaminate), ("encode", encode)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's rows are deleted when the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, step in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        common.drop(spark, before)
        before = [path]
    return docs
