"""Article metadata and identifiers of the literature database, from payloads that were fetched elsewhere."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The service's address and what its answers are asked for again on.
SERVICE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
AGAIN_ON = (500, 502, 503, 504, 400)
METADATA = "pmid string, title string, journal string, year int, authors string, abstract string, citation string, comment string, doi string, keywords string, mesh string"
_EMPTY = dict.fromkeys("pmid title journal year authors abstract citation comment doi keywords mesh".split())


def _all(node: ET.Element | None) -> str | None:
    return None if node is None else (node.text or "") if not len(node) else "".join(node.itertext())


def metadata_of(xml: str | None) -> dict | None:
    """The fields of an article's XML, or None if there is none in it. Parts that repeat are joined by ` | `, authors by `;`."""
    import re

    if not xml:
        return None
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", xml))
    except ET.ParseError:
        return None
    top = root if root.tag == "PubmedArticle" else root.find("PubmedArticle")
    article = top.find("MedlineCitation/Article") if top is not None else None
    if article is None:
        return None
    dated = article.find("ArticleDate")
    year = (dated if dated is not None else article).findtext("Year" if dated is not None else "Journal/JournalIssue/PubDate/Year")
    doi = next((_all(e) for e in article.findall("ELocationID") if e.get("EIdType") == "doi"), None)
    listed = article.findall("AuthorList/Author")
    full = [a for a in listed if a.find("ForeName") is not None] if len(listed) > 1 else listed
    named = [(a.findtext("LastName"), a.findtext("ForeName")) for a in full]
    authors = ";".join(f"{last}, {fore}" for last, fore in named) if listed and all(last and fore for last, fore in named) else None
    parts = article.findall("Abstract/AbstractText")
    ids = top.findall("PubmedData/ArticleIdList/ArticleId")
    abstract = " | ".join(_all(p) or "" for p in parts)
    return _EMPTY | {
        "pmid": top.findtext("MedlineCitation/PMID"), "title": _all(article.find("ArticleTitle")), "journal": article.findtext("Journal/Title"), "year": int(year) if year and year.isdecimal() else None, "authors": authors, "abstract": abstract,
        "comment": abstract, "doi": doi, "keywords": "", "citation": _all(ids[1] if len(ids) > 1 else ids[0]) if ids else None, "mesh": " | ".join(_all(m.find("DescriptorName")) or "" for m in top.findall("MedlineCitation/MeshHeadingList/MeshHeading")),
    }


def metadata(payloads: DataFrame, xml: str = "xml") -> DataFrame:
    """payloads with a struct column meta, null where the payload isn't an article."""

    @F.pandas_udf(f"struct<{METADATA.replace(' ', ':').replace(',:', ',')}>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([metadata_of(x) or _EMPTY for x in s], columns=list(_EMPTY)).astype({"year": "Int32"})

    out = payloads.withColumn("meta", read(F.col(xml)))
    return out.withColumn("meta", F.when(F.col("meta.pmid").isNotNull(), F.col("meta")))


def search_ids(xml: str = "xml") -> Column:
    """The identifiers in a search answer."""
    return F.regexp_extract_all(F.col(xml), F.lit(r"(?i)<id>\s*(\d+)\s*</id>"), F.lit(1))


def pmc_id(answer: str = "answer") -> Column:
    """The full-text identifier in a link answer, with its prefix; null if it isn't there."""
    kind = "linksets array<struct<linksetdbs:array<struct<links:array<string>>>>>"
    first = F.get(F.get(F.get(F.from_json(F.col(answer), kind)["linksets"], F.lit(0))["linksetdbs"], F.lit(0))["links"], F.lit(0))
    return F.when(F.startswith(first, F.lit("PMC")), first).otherwise(F.concat(F.lit("PMC"), first))


def provider_urls(answer: str = "answer") -> Column:
    """Addresses of the full text at its providers."""
    kind = "linksets array<struct<idurllist:array<struct<objurls:array<struct<provider:struct<nameabbr:string>,url:struct<value:string>>>>>>>"
    objs = F.get(F.get(F.from_json(F.col(answer), kind)["linksets"], F.lit(0))["idurllist"], F.lit(0))["objurls"]
    return F.filter(F.transform(F.coalesce(objs, F.array()), lambda o: o.url.value), lambda u: F.coalesce(u != "", F.lit(False)))


def converted(xml: str = "xml") -> Column:
    """(pmid, pmcid) pairs of an identifier converter's answer."""
    record = F.regexp_extract_all(F.col(xml), F.lit(r"(<record\s[^>]*>)"), F.lit(1))
    of = lambda r, k: F.nullif(F.regexp_extract(r, rf'\b{k}="([^"]*)"', 1), F.lit(""))
    return F.transform(record, lambda r: F.struct(of(r, "pmid").alias("pmid"), of(r, "pmcid").alias("pmcid")))


def query(journal: str, search: str = "") -> str:
    """A search for the articles of a journal."""
    return f"({journal}[Journal]+journal+article[pt]{'+' + search if search else ''})".replace(" ", "+")


class Client:
    """Asks the service; used on the driver, or inside mapInPandas for many identifiers."""

    def __init__(self, api_key: str | None = None, retries: int = 5, wait: float = 1.0) -> None:
        self.api_key, self.retries, self.wait = api_key, retries, wait

    def ask(self, tool: str, **params: object) -> str:
        sent = {k: v for k, v in params.items() if v is not None} | ({"api_key": self.api_key} if self.api_key else {})
        url = f"{SERVICE}{tool}.fcgi?{urllib.parse.urlencode(sent)}"
        for k in range(self.retries + 1):
            try:
                with urllib.request.urlopen(url, timeout=10) as r:
                    return r.read().decode()
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN_ON or k == self.retries:
                    raise
            except urllib.error.URLError:
                if k == self.retries:
                    raise
            time.sleep(self.wait * 2**k)
        raise RuntimeError("not reached")

    def search(self, term: str, start: int = 0, most: int = 10_000) -> list[str]:
        import re

        return re.findall(r"(?i)<id>\s*(\d+)\s*</id>", self.ask("esearch", db="pubmed", term=term, retstart=start, retmax=most))

    def fetch(self, pmid: str, mode: str = "txt", kind: str = "medline", db: str = "pubmed") -> str:
        return self.ask("efetch", db=db, id=pmid, retmode=mode, rettype=kind)

    def link(self, pmid: str, mode: str = "ref", access: str | None = None) -> dict | str:
        found = self.ask("elink", dbfrom="pubmed", id=pmid, retmode=mode, **({"linkname": "pubmed_pmc"} if access == "pmc" else {"cmd": "prlinks"}))
        return json.loads(found) if mode == "json" else found
