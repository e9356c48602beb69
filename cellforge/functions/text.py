"""Expressions over page text and links: validity, publisher, characters, cleaned text, coordinate space, addresses."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from cellforge.functions.dom import clean_text, parse, readable_text
from cellforge.sources.registry import ENTITIES, Publisher, publishers

U = "(?dU)"

# What a page says that isn't the one that was asked for.
BLOCKED = [
    "Checking if you are a human", "Please turn JavaScript on and reload the page", "Checking if the site connection is secure", "Enable JavaScript and cookies to continue",
    "There was a problem providing the content you requested", "<title>Redirecting</title>", "<title>Page not available - PMC</title>", "Your request cannot be processed at this time. Please try again later",
    "403 Forbidden", "Page not found — ScienceDirect", "This site can’t be reached", "used Cloudflare to restrict access", "502 Bad Gateway", "Checking your browser before accessing",
    "Checking your browser - reCAPTCHA", "/recaptcha/challengepage/", "g-recaptcha",
]
# Words that tell a coordinate space.
SOFTWARE = {"MNI": ("spm", "fsl"), "TAL": ("afni", "brainvoyager")}
SPACE_WORDS = {"MNI": "mni", "TAL": "talairach"}


def is_valid_page(html: str = "html") -> Column:
    """Whether no marker of a blocked or broken page is in it."""
    return ~reduce(Column.__or__, [F.contains(F.col(html), F.lit(b)) for b in BLOCKED])


def identify(html: str = "html", known: list[Publisher] | None = None, default: str | None = None) -> Column:
    """The name of the first publisher with an identifier in the page; `default` for pages of none (null: they are dropped later)."""
    hits = [F.when(reduce(Column.__or__, [F.regexp_like(F.col(html), F.lit(p)) for p in k.identifiers]), k.name) for k in known or publishers() if k.identifiers]
    return F.coalesce(*hits, F.lit(default).cast("string"))


def decode_entities(text: Column | str, entities: dict[str, str] = ENTITIES) -> Column:
    """Odd characters as what they stand for: named ones first, then single characters in one pass."""
    out = F.col(text) if isinstance(text, str) else text
    for k, v in entities.items():
        if len(k) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    single = sorted((k for k in entities if len(k) == 1), key=lambda k: entities[k] == "")
    return F.translate(out, "".join(single), "".join(entities[k] for k in single))


def decode_by_source(text: str, source: str) -> Column:
    """Characters by the page's publisher; pages of no publisher are left alone."""
    own = {k.name: k.entities for k in publishers()}
    plain = decode_entities(text)
    special = [(n, e) for n, e in own.items() if e != ENTITIES]
    out = F.when(F.col(source).isNull() | ~F.col(source).isin(*own), F.col(text))
    for n, e in special:
        out = out.when(F.col(source) == n, decode_entities(text, e))
    return out.otherwise(plain)


def normalized(text: str | Column, most: int | None = None) -> Column:
    """White space as single spaces, trimmed, lower case; the first `most` characters."""
    out = F.lower(F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)\s+", " ")))
    return F.left(out, F.lit(most)) if most else out


@pandas_udf(StringType())
def readable(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in html:
        yield s.map(lambda h: None if h is None else clean_text(parse(h)))


@pandas_udf(StringType())
def readable_main(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As `readable`, of the part of a page whose paragraphs weigh most."""
    for s in html:
        yield s.map(lambda h: None if h is None else readable_text(parse(h)))


@pandas_udf(ArrayType(StringType()))
def links(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Targets of the anchors of a page, in order."""
    for s in html:
        yield s.map(lambda h: [] if not h else [a.get("href") for a in parse(h).find_all("a") if "href" in a.attrs])


@pandas_udf(StructType([StructField("doi", StringType()), StructField("pmid", StringType())]))
def identifiers(html: pd.Series, source: pd.Series) -> pd.DataFrame:
    """The DOI and the article number that a page tells."""
    from cellforge.sources import extractors

    found = []
    for h, s in zip(html, source, strict=True):
        root = parse(h or "")
        found.append((extractors.doi(root, s), extractors.pmid(root, s)))
    return pd.DataFrame(found, columns=["doi", "pmid"], dtype=object)


def guess_space(text: str | Column) -> Column:
    """MNI, TAL or UNKNOWN by the software, else the space, that a text names with 30 characters on both sides in its line."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    # the word first, then what is around it: a scan for the text before it would try every position
    named = lambda w: F.contains(low, F.lit(w)) & F.regexp_like(low, F.lit(rf"{U}\b{w}(?<=\b.{{30,40}}{w})(?=.{{30,40}}\b)"))
    by = {k: named(ws[0]) | named(ws[1]) for k, ws in SOFTWARE.items()}
    none = ~by["MNI"] & ~by["TAL"]
    mni, tal = named(SPACE_WORDS["MNI"]), named(SPACE_WORDS["TAL"])
    return F.when((by["MNI"] & ~by["TAL"]) | (none & mni & ~tal), "MNI").when((by["TAL"] & ~by["MNI"]) | (none & tal & ~mni), "TAL").otherwise("UNKNOWN")


def collection_link(href: str | Column) -> Column:
    """(type, id) of a link to an image or collection of the image repository, or null; images are tried first."""
    h = F.col(href) if isinstance(href, str) else href
    first = lambda p: F.coalesce(F.nullif(F.regexp_extract(h, p, 1), F.lit("")), F.nullif(F.regexp_extract(h, p, 2), F.lit("")))
    image = first(r"identifiers\.org/neurovault\.image:(\d*)|neurovault\.org/images/(\d*)")
    collection = first(r"identifiers\.org/neurovault\.collection:(\w*)|neurovault\.org/collections/(\w*)")
    return F.when(image.isNotNull(), F.struct(F.lit("image").alias("type"), image.alias("id"))).when(collection.isNotNull(), F.struct(F.lit("collection").alias("type"), collection.alias("id")))


def skips(url: str, parts: str | list[str | None] | None) -> Column:
    """Whether an address holds one of the parts, in any case; blank parts don't count."""
    wanted = [p.strip().lower() for p in ([parts] if isinstance(parts, str) else parts or []) if p and p.strip()]
    return reduce(Column.__or__, [F.contains(F.lower(F.col(url)), F.lit(p)) for p in wanted], F.lit(False))


def full_text_url(url: str, journal: str) -> Column:
    """The address of an article's full text, by journal and host."""
    u, j = F.col(url), F.lower(F.col(journal))
    has = lambda c, p: F.contains(c, F.lit(p))
    doi = F.regexp_extract(u, r"(journal\.\w+\.\d+)", 1)
    return (
        F.when(has(j, "plos") & (doi != ""), F.concat(F.lit("http://journals.plos.org/plosone/article/asset?id=10.1371/"), doi, F.lit(".XML")))
        .when(j.isin("human brain mapping", "european journal of neuroscience", "brain and behavior", "epilepsia", "journal of neuroimaging"), F.regexp_replace(F.replace(u, F.lit("abstract"), F.lit("full")), ";.*$", ""))
        .when(j == "journal of cognitive neuroscience", F.replace(u, F.lit("doi/abs"), F.lit("doi/full")))
        .when(has(j, "frontiers in") & F.regexp_like(u, F.lit("(full|abstract)$")), F.regexp_replace(u, "(full|abstract)$", "xml/nlm"))
        .when(has(u, "sciencedirect"), F.concat(u, F.lit("?np=y")))
        .when(has(u, "springer"), F.concat(u, F.lit("/fulltext.html")))
        .otherwise(u)
    )


def base_url(meta: Column) -> Column:
    """The folder of an address, without query and fragment."""
    bare = F.regexp_replace(meta, r"[?#].*$", "")
    return F.when(F.regexp_like(bare, F.lit(r"//[^/]+/.*\.[^/]*$")), F.regexp_replace(bare, r"/[^/]*$", "/")).otherwise(bare)


@pandas_udf(StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link's full address; null for empty ones, fragments and what isn't a page."""

    def one(b: str | None, h: str | None) -> str | None:
        h = (h or "").strip()
        if not h or h.startswith("#") or h.lower().startswith(("javascript:", "mailto:", "tel:")):
            return None
        return h if h.lower().startswith(("http://", "https://")) else urljoin(b, h) if b else None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def last_word(label: Column) -> Column:
    return F.trim(F.element_at(F.split(label, " "), -1))


def first_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"(\d+)", 1), F.lit(""))


def split_caption(text: Column) -> tuple[Column, Column]:
    """Label and caption of a caption that begins with `Table N`."""
    p = r"(?i)^(Table\s*\d+)\b\.?"
    return F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.regexp_replace(F.regexp_replace(text, p, ""), r"^[. ]+", "")
