"""Which articles to fetch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.functions import text as T
from cellforge.operators import relational

UNKNOWN = "UNKNOWN"


def wanted(ids: DataFrame, on_disk: DataFrame | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """ids (pmid) that aren't on disk and lie in the range, ends included."""
    out = ids
    if least is not None:
        out = out.where(F.col("pmid") >= least)
    if most is not None:
        out = out.where(F.col("pmid") <= most)
    return relational.new_only(out, on_disk, "pmid") if on_disk is not None else out


def with_full_text_ids(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """ids with pmcid of pairs (pmid, pmcid), null where there is none."""
    return ids.join(pairs.select("pmid", "pmcid"), "pmid", "left")


def with_journals(ids: DataFrame, journals: DataFrame) -> DataFrame:
    return ids.join(journals.select("pmid", "journal"), "pmid", "left").withColumn("journal", F.coalesce("journal", F.lit(UNKNOWN)))


def without_open_access(ids: DataFrame, open_access: DataFrame) -> DataFrame:
    """ids without those whose full text is in open_access (pmcid)."""
    return ids.join(open_access.select("pmcid"), "pmcid", "left_anti")


def by_full_text(ids: DataFrame, prefer: bool | str) -> DataFrame:
    """ids with from_full_text; `only` keeps those that have one."""
    has = F.col("pmcid").isNotNull()
    if prefer == "only":
        return ids.where(has).withColumn("from_full_text", F.lit(True))
    return ids.withColumn("from_full_text", has if prefer else F.lit(False))


def missing_dois(dois: DataFrame, found: DataFrame) -> DataFrame:
    """dois (doi) that no article was found for."""
    return dois.join(found.select("doi"), "doi", "left_anti")


def take_new(articles: DataFrame, most: int) -> DataFrame:
    """articles (rank, is_new_valid) in order of rank until `most` new valid ones have been met."""
    return relational.up_to(articles, "rank", "is_new_valid", most)


def cached(ids: DataFrame, cache: DataFrame, key: str = "pmid") -> tuple[DataFrame, DataFrame]:
    """(what the cache has of ids, ids that are still to be fetched)."""
    return cache.join(ids.select(key), key, "left_semi"), relational.new_only(ids, cache, key)


def store_pages(pages: DataFrame, folder: str, stored: DataFrame | None = None) -> DataFrame:
    """Writes valid pages (pmid, journal, html) that aren't stored, a folder for each journal; returns pmids that failed."""
    new = relational.new_only(pages, stored, "pmid") if stored is not None else pages
    gates = new.withColumn("valid", F.coalesce(T.is_valid_page(), F.lit(False)))
    gates.where("valid").drop("valid").write.mode("append").partitionBy("journal").parquet(folder)
    return gates.where("NOT valid").select("pmid")


@dataclass(frozen=True)
class Plan:
    """What to fetch: (pmid, pmcid, journal, url, from_full_text), pmcids that are open and left out, and DOIs without an article."""

    fetch: DataFrame
    open_access: DataFrame
    missing: DataFrame | None


def plan(ids: DataFrame, pairs: DataFrame, journals: DataFrame, on_disk: DataFrame | None = None, least: int | None = None, most: int | None = None, open_access: DataFrame | None = None, prefer: bool | str = True, addresses: DataFrame | None = None, skip: list[str] | None = None, dois: DataFrame | None = None, limit: int | None = None) -> Plan:
    """Which of ids (pmid; doi where dois are asked for) to fetch, and from where.

    Stored and out-of-range numbers go first. Full texts that are open_access (pmcid) are left out and listed. Addresses (pmid,
    url, a provider's) become those of full texts by journal; those that hold a part in skip are left out. With a limit, the
    first so many numbers in order are fetched.
    """
    chosen = with_full_text_ids(wanted(ids.select("pmid").distinct(), on_disk, least, most), pairs)
    none = chosen.limit(0).select("pmcid")
    listed = none if open_access is None else chosen.join(open_access.select("pmcid"), "pmcid", "left_semi").select("pmcid")
    if open_access is not None:
        chosen = without_open_access(chosen, open_access)
    chosen = by_full_text(with_journals(chosen, journals), prefer)
    if addresses is not None:
        chosen = chosen.join(addresses.select("pmid", "url"), "pmid", "left").withColumn("url", T.full_text_url("url", "journal")).where(F.col("url").isNull() | ~T.skips("url", skip))
    else:
        chosen = chosen.withColumn("url", F.lit(None).cast("string"))
    chosen = chosen.select("pmid", "pmcid", "journal", "url", "from_full_text")
    if limit is not None:
        chosen = relational.up_to(chosen.withColumn("_new", F.lit(True)), "pmid", "_new", limit).drop("_new")
    return Plan(chosen, listed, None if dois is None else missing_dois(dois, ids))
