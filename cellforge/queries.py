"""Queries over the driver's tables, one or more for each operator, with SQL that computes the same independently.

The tables hold no articles with numeric tables, so most queries first derive such input from a table: HTML is
written from embeddings, then read back by the whole extraction. Each docstring says what is derived. Nothing
is limited, and every derived page or table has a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.functions import text as T
from cellforge.operators import cells, features, headers, qc, records, relational
from cellforge.plans import export, ingest, retrieval
from cellforge.sources import pubmed
from cellforge.sources.registry import IDENTIFIERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Rows of a derived HTML table.
ROWS = 25


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinate(k: int, scale: int) -> Column:
    return F.floor(F.col("embedding")[k].cast("double") * scale).cast("int")


def points(spark: SparkSession, sf_dir: str, scale: int = 300) -> DataFrame:
    """vec_id, label, doc (ROWS vectors each) and x, y, z from the first three components; two zeros in every seventh row."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / ROWS).cast("long").alias("doc"), *[coordinate(k, scale).alias(a) for k, a in enumerate("xyz")])
    return e.withColumns({a: F.when(F.col("vec_id") % 7 == 0, 0).otherwise(F.col(a)) for a in "xy"})


POINTS = """
p0 AS (SELECT vec_id, label, CAST(floor(vec_id / 25) AS BIGINT) AS doc, CAST(floor(CAST(embedding[1] AS DOUBLE) * {s}) AS INT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE) * {s}) AS INT) AS y, CAST(floor(CAST(embedding[3] AS DOUBLE) * {s}) AS INT) AS z FROM embeddings),
p AS (SELECT vec_id, label, doc, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE x END AS x, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE y END AS y, z FROM p0)
"""
VALID = "greatest(abs(x), abs(y), abs(z)) < 100 AND CAST(x = 0 AS INT) + CAST(y = 0 AS INT) + CAST(z = 0 AS INT) < 2"


def html_tables(rows: DataFrame, head: str, row: Column, order: str = "vec_id") -> DataFrame:
    """Pages (doc_id, html) with one table each, of `rows` (doc, ...) in order."""
    each = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*[c for c in order.split(",")], row.alias("html")))).alias("trs"))
    body = F.array_join(F.transform("trs", lambda t: t.html), "")
    return each.select(F.col("doc").alias("doc_id"), F.concat(F.lit(f"<html><body><p>Results</p><table>{head}"), body, F.lit("</table></body></html>")).alias("html"))


def tr(*parts: Column | str) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.lit(p) if isinstance(p, str) else p.cast("string"), F.lit("</td>")) for p in parts], F.lit("</tr>"))


@query(f"""
WITH {POINTS.format(s=300)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY vec_id) AS n FROM p)
SELECT doc AS doc_id, CAST(n AS INT) AS row_ix, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, 'area ' || label AS region, CAST(vec_id AS VARCHAR) AS size FROM r WHERE {VALID}
""")
def html_roundtrip_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a table of coordinates, from embeddings, through grid, headers, records and validity."""
    pages = html_tables(points(spark, sf_dir), "<tr><th>Region</th><th>x</th><th>y</th><th>z</th><th>Voxels</th></tr>", tr(F.concat(F.lit("area "), "label"), *map(F.col, "xyz"), F.col("vec_id")))
    return records.records(cells.extract(pages)).select("doc_id", "row_ix", "x", "y", "z", "region", "size")


@query(f"""
WITH {POINTS.format(s=300)}
SELECT doc AS doc_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(vec_id AS VARCHAR) AS region, 'set ' || label AS heading FROM p WHERE {VALID}
""")
def group_row_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, rows ordered by label, with a heading row over all columns before each one."""
    p = points(spark, sf_dir)
    first = p.groupBy("doc", "label").agg(F.min("vec_id").alias("first"))
    p = p.join(first, ["doc", "label"])
    heading = F.concat(F.lit("<tr><td colspan=4>set "), F.col("label").cast("string"), F.lit("</td></tr>"))
    row = F.concat(F.when(F.col("vec_id") == F.col("first"), heading).otherwise(""), tr(F.col("vec_id"), *map(F.col, "xyz")))
    pages = html_tables(p, "<tr><th>Region name</th><th>x</th><th>y</th><th>z</th></tr>", row, "label,vec_id")
    return records.records(cells.extract(pages)).select("doc_id", "x", "y", "z", "region", F.array_join("groups", "|").alias("heading"))


@query(f"""
WITH {POINTS.format(s=300)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY vec_id) + 1 AS n FROM p),
u AS (SELECT doc, n, 0 AS g, x, y, z, 'First' AS name FROM r UNION ALL SELECT doc, n, 1, z, y - 1, x + 1, 'Second' FROM r)
SELECT doc AS doc_id, CAST(n AS INT) AS row_ix, g AS group_ix, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, name AS heading FROM u WHERE {VALID}
""")
def repeating_groups_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks of x, y, z under labels over three columns each, unpivoted to a record for each block."""
    head = "<tr><th rowspan=2>Region</th><th colspan=3>First</th><th colspan=3>Second</th></tr><tr><th>x</th><th>y</th><th>z</th><th>x</th><th>y</th><th>z</th></tr>"
    pages = html_tables(points(spark, sf_dir), head, tr(F.concat(F.lit("area "), "label"), *map(F.col, "xyz"), F.col("z"), F.col("y") - 1, F.col("x") + 1))
    return records.records(cells.extract(pages)).select("doc_id", "row_ix", "group_ix", "x", "y", "z", F.array_join("groups", "|").alias("heading"))


@query("""
WITH n AS (SELECT r_name, n_name, n_nationkey, row_number() OVER (ORDER BY r_regionkey, n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CAST(i AS INT) AS row_ix, 0 AS col_ix, r_name AS text, 1 AS span FROM n UNION ALL SELECT CAST(i AS INT), 1, n_name, 2 FROM n
UNION ALL SELECT CAST(i AS INT), 2, n_name, 2 FROM n UNION ALL SELECT CAST(i AS INT), 3, CAST(n_nationkey AS VARCHAR), 1 FROM n
UNION ALL SELECT 0, 0, 'Region', 1 UNION ALL SELECT 0, 1, 'Nation', 2 UNION ALL SELECT 0, 2, 'Nation', 2 UNION ALL SELECT 0, 3, 'Key', 1
""")
def rowspan_colspan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a table whose region cells span rows and name cells two columns, as the cells relation."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sizes = n.groupBy("r_regionkey").agg(F.count("*").alias("size"), F.min("n_nationkey").alias("first"))
    n = n.join(sizes, "r_regionkey").withColumn("doc", F.lit(1).cast("long"))
    region = F.when(F.col("n_nationkey") == F.col("first"), F.concat(F.lit("<td rowspan="), F.col("size").cast("string"), F.lit(">"), "r_name", F.lit("</td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), region, F.lit("<td colspan=2>"), "n_name", F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    pages = html_tables(n, "<tr><th>Region</th><th colspan=2>Nation</th><th>Key</th></tr>", row, "r_regionkey,n_nationkey")
    return cells.cells(cells.extract(pages)).select("row_ix", "col_ix", "text", "span")


@query(f"""
WITH {POINTS.format(s=300)}
SELECT vec_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM p WHERE {VALID}
""")
def coord_triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates as one text, `x, y; z` with typographic minus signs."""
    minus = lambda c: F.replace(F.col(c).cast("string"), F.lit("-"), F.lit("−"))
    text = F.concat(minus("x"), F.lit(", "), minus("y"), F.lit("; "), minus("z"))
    pages = html_tables(points(spark, sf_dir), "<tr><th>Name</th><th>MNI coordinates</th></tr>", tr(F.concat(F.lit("v"), F.col("vec_id").cast("string")), text))
    found = records.records(cells.extract(pages))
    return found.select(F.substring(F.element_at("columns", "name"), 2, 20).cast("long").alias("vec_id"), "x", "y", "z")


LABELS = ["Brain region", "BA", "x", "y", "z", "z score", "Hem", "Size (mm3)", "p value", "T", "x [mm]", "y (mm)", "Z", "k", "MNI coordinates", "Area (mm3)", "Side", "comment", "Max T", "Co-ordinates", "cluster coordinate value"]


@query(f"""
WITH names AS (SELECT [{", ".join(f"'{v}'" for v in LABELS)}] AS l),
c AS (SELECT p_partkey // 5 AS doc_id, CAST(p_partkey % 5 AS INT) AS col_ix, lower(l[1 + (p_partkey * 7 + p_size) % {len(LABELS)}]) AS label FROM part, names),
k AS (SELECT *, CASE
  WHEN regexp_matches(label, '(^\\s*ba$)|brodmann') THEN 'ba' WHEN regexp_matches(label, 'region|anatom|location|area') THEN 'region'
  WHEN regexp_matches(label, 'sphere|(^\\s*h$)|^\\s*hem|^\\s*side') THEN 'hemisphere' WHEN regexp_matches(label, '(^k$)|(mm.*?3)|volume|voxels|size|extent') THEN 'size'
  WHEN regexp_matches(label, '\\bx\\b.*\\by\\b.*\\bz\\b|mni\\s*coordinates?|talairach\\s*coordinates?|peak\\s*voxel\\s*coordinate') THEN 'coord_triplet'
  WHEN regexp_matches(label, 'coordinates?') AND NOT regexp_matches(label, 'cluster|score|value') THEN 'coord_triplet'
  WHEN regexp_matches(label, '^\\s*y\\b') THEN 'y' WHEN regexp_matches(label, '^\\s*x\\b') THEN 'x' WHEN regexp_matches(label, '^\\s*z\\b') THEN 'z?'
  WHEN regexp_matches(label, 'rdinate') THEN 'coord_triplet' WHEN label = 't' OR regexp_matches(label, '^(max.*(z|t).*|.*(z|t).*(score|value|max))$') THEN 'statistic'
  WHEN regexp_matches(label, 'p[-\\s]+.*val') THEN 'p_value' END AS kind FROM c),
w AS (SELECT *, coalesce(bool_or(kind IN ('x', 'y', 'coord_triplet')) OVER (PARTITION BY doc_id ORDER BY col_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS met, lag(kind) OVER (PARTITION BY doc_id ORDER BY col_ix) AS before FROM k)
SELECT doc_id, col_ix, label, CASE WHEN kind = 'z?' THEN CASE WHEN NOT met OR (col_ix > 0 AND before IS DISTINCT FROM 'y') THEN 'statistic' ELSE 'z' END ELSE kind END AS std FROM w
""")
def column_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a fixed list, dealt to tables of five columns by part, and their standard kinds."""
    part = read(spark, sf_dir, "part")
    label = F.lower(F.get(F.array(*map(F.lit, LABELS)), ((F.col("p_partkey") * 7 + F.col("p_size")) % len(LABELS)).cast("int")))
    t = part.groupBy(F.floor(F.col("p_partkey") / 5).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("p_partkey") % 5).cast("int").alias("at"), label.alias("label")))).alias("l"))
    # the first and the last table may lack columns; the position is that of the part
    t = t.withColumn("table_ix", F.lit(0)).withColumn("labels", F.transform("l", lambda x: x.label)).withColumn("at", F.transform("l", lambda x: x["at"]))
    c = headers.with_kinds(t).select("doc_id", F.explode(F.arrays_zip("at", "labels", "std")).alias("c"))
    return c.select("doc_id", F.col("c.at").alias("col_ix"), F.col("c.labels").alias("label"), F.col("c.std").alias("std"))


@query(f"WITH {POINTS.format(s=600)} SELECT vec_id, x, y, z FROM p WHERE {VALID}")
def validity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates from embeddings, wide enough that many are invalid."""
    return points(spark, sf_dir, 600).where(records.is_valid()).select("vec_id", "x", "y", "z")


@query(f"""
WITH m AS (SELECT [{", ".join("'" + b.replace("'", "''") + "'" for b in T.BLOCKED)}] AS marks),
h AS (SELECT page_id, html || CASE WHEN page_id % 5 = 0 THEN marks[1 + page_id % 17] ELSE '' END AS html, marks FROM pages, m)
SELECT page_id, len(list_filter(marks, lambda k: contains(html, k))) = 0 AS valid FROM h
""")
def scrape_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, one in five with a marker of a blocked page added, and whether they are valid."""
    mark = F.when(F.col("page_id") % 5 == 0, F.get(F.array(*map(F.lit, T.BLOCKED)), (F.col("page_id") % len(T.BLOCKED)).cast("int"))).otherwise("")
    return read(spark, sf_dir, "pages").withColumn("html", F.concat("html", mark)).select("page_id", T.is_valid_page().alias("valid"))


_TOLD = {"Frontiers": IDENTIFIERS["Frontiers"][0], "OUP": IDENTIFIERS["OUP"][0], "PMC": IDENTIFIERS["PMC"][0], "Wiley": IDENTIFIERS["Wiley"][0], "ScienceDirect": IDENTIFIERS["ScienceDirect"][1]}
_NAMES = sorted(_TOLD)


@query(f"""
WITH m AS (SELECT [{", ".join(f"'{_TOLD[n]}'" for n in _NAMES)}] AS marks, {_NAMES} AS names)
SELECT page_id, CASE WHEN page_id % 8 < 5 THEN names[1 + page_id % 8] WHEN page_id % 8 = 5 THEN 'OUP' WHEN page_id % 8 = 7 THEN 'Default' END AS source FROM pages, m
""")
def source_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a publisher's identifier added (two of them in one of eight, the earlier name wins), and the publisher found."""
    k = F.col("page_id") % 8
    mark = F.when(k < 5, F.get(F.array(*[F.lit(_TOLD[n]) for n in _NAMES]), k.cast("int"))).when(k == 5, F.lit(_TOLD["Wiley"] + _TOLD["OUP"])).otherwise("")
    pages = read(spark, sf_dir, "pages").withColumn("html", F.concat("html", mark))
    return pages.select("page_id", F.coalesce(T.identify(), F.when(k == 7, "Default")).alias("source"))


@query("""
WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages)
SELECT page_id, CAST(i - 1 AS INT) AS ix, hs[i] AS href FROM (SELECT page_id, hs, unnest(range(1, len(hs) + 1)) AS i FROM l)
""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of the links of pages, in order."""
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(T.links("html")).alias("ix", "href"))


@query("""
WITH a AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://neurovault.org/images/' || page_id WHEN 1 THEN 'http://identifiers.org/neurovault.collection:' || page_id WHEN 2 THEN 'https://neurovault.org/collections/C' || page_id ELSE url END AS url FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image' ELSE 'collection' END AS type, CASE page_id % 4 WHEN 2 THEN 'C' ELSE '' END || page_id AS id FROM a WHERE page_id % 4 < 3
""")
def repository_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link to an image or a collection, by page number, and the identifier linked to."""
    at = F.col("page_id").cast("string")
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("https://neurovault.org/images/"), at)).when(k == 1, F.concat(F.lit("http://identifiers.org/neurovault.collection:"), at)).when(k == 2, F.concat(F.lit("https://neurovault.org/collections/C"), at)).otherwise(F.col("url"))
    html = F.concat(F.lit('<p>see <a href="'), url, F.lit('">data</a></p>'))
    found = ingest.repository_links(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), html.alias("html")))
    return found.select(F.col("article_id").alias("page_id"), "type", F.col("neurovault_id").alias("id"))


@query(r"""
WITH s AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS signature FROM documents)
SELECT min(doc_id) AS doc_id, CAST(length(signature) AS INT) AS n_chars FROM s GROUP BY signature
""")
def signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normalised text."""
    d = read(spark, sf_dir, "documents").select("doc_id", T.normalized("text").alias("signature"))
    d = d.select("doc_id", F.length("signature").alias("n_chars"), F.sha2("signature", 256).alias("mark"))
    return relational.first_of_each(d.withColumn("at", F.col("doc_id")), ["mark"], "at").select("doc_id", "n_chars")


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n_records, count(DISTINCT l_suppkey) AS n_tables, o_orderstatus = 'P' AS missing FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n_records DESC, n_tables DESC, missing, n_tables > 0 DESC, o_orderkey) AS n FROM c)
SELECT o_custkey, o_orderkey, n_records, n_tables FROM r WHERE n = 1
""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's best order: most lines, then suppliers, then not pending, then the first."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_records"), F.count_distinct("l_suppkey").alias("n_tables"))
    c = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    c = c.select("o_custkey", "o_orderkey", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_tables", F.lit(0)).alias("n_tables"), (F.col("o_orderstatus") == "P").alias("missing"))
    return relational.best(c, "o_custkey", relational.quality("n_records", "n_tables", "missing"), "o_orderkey").drop("missing")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that aren't among those of urgent orders."""
    stored = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.new_only(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), stored, "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers stored; every third one comes again, with another balance, and replaces what is stored."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return relational.upsert(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey", True)


@query("SELECT 'articles' AS relation, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'tables', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation go, and their orders with them: what is left."""
    c = read(spark, sf_dir, "customer")
    own = {"articles": c.select(F.col("c_custkey").alias("id")), "tables": read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("article_id"))}
    left = relational.without(own, c.where("c_nationkey = 3").select(F.col("c_custkey").alias("article_id")))
    n = lambda k: left[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("relation"), "n")
    return n("articles").union(n("tables"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 5000)
""")
def export_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have a large order, or a rich supplier in their nation."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    large = relational.with_children(c, "c_custkey", (read(spark, sf_dir, "orders").where("o_totalprice > 250000"), "o_custkey"))
    rich = relational.with_children(c, "c_nationkey", (read(spark, sf_dir, "supplier").where("s_acctbal > 5000"), "s_nationkey"))
    return large.union(rich).distinct().select("c_custkey", "c_name")


def _relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The store's relations from customers (articles), orders (tables), lines (records) and suppliers (links)."""
    c, o, li, s = (read(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier"))
    articles = c.select(F.col("c_custkey").alias("id"), F.lit("10/").alias("doi"), F.col("c_mktsegment").alias("authors"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("journal"), F.col("c_nationkey").alias("year"), F.lit("MNI").alias("space"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("abstract"))
    n = li.groupBy("l_orderkey").agg(F.count("*").alias("n_activations"))
    tables = o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("article_id"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("caption"), F.coalesce("n_activations", F.lit(0)).alias("n_activations"))
    found = li.select(F.col("l_orderkey").alias("table_id"), F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.col("l_tax").alias("z"), F.lit(None).cast("string").alias("p_value"), F.col("l_returnflag").alias("region"), F.lit(None).cast("string").alias("size"), F.col("l_linestatus").alias("statistic"), F.when(F.col("l_linenumber") > 1, F.array("l_returnflag", "l_linestatus")).alias("groups"))
    links = s.select(F.col("s_suppkey").alias("article_id"), F.when(F.col("s_suppkey") % 2 == 0, "image").otherwise("collection").alias("type"), F.col("s_nationkey").alias("neurovault_id"))
    return {"articles": articles, "tables": tables, "records": found, "links": links}


@query("""
WITH t AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT (SELECT count(*) FROM customer) AS n_articles, (SELECT count(DISTINCT o_custkey) FROM t WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS n_articles_with_records, (SELECT count(*) FROM t) AS n_tables,
       (SELECT count(*) FROM lineitem) AS n_records, (SELECT count(*) FROM supplier) AS n_links, (SELECT count(DISTINCT s_suppkey) FROM supplier) AS n_articles_with_links
""")
def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the store's relations."""
    return relational.store_stats(**_relations(spark, sf_dir))


@query("""
WITH a AS (SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey))
SELECT (SELECT count(*) FROM a) AS n_articles, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN a ON o_custkey = c_custkey) AS n_activations, (SELECT count(*) FROM orders JOIN a ON o_custkey = c_custkey) AS n_tables,
       (SELECT count(*) FROM supplier JOIN a ON s_suppkey = c_custkey WHERE s_suppkey % 2 = 1) AS n_nv_collections, (SELECT count(*) FROM supplier JOIN a ON s_suppkey = c_custkey WHERE s_suppkey % 2 = 0) AS n_nv_images
""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what an export of articles that aren't empty holds."""
    return export.manifest(export.relations(**_relations(spark, sf_dir))).drop("exported")


@query("""
SELECT o_custkey AS pmid, o_orderkey AS table_id, o_orderstatus AS table_label, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y, l_tax AS z, CAST(NULL AS VARCHAR) AS p_value, l_returnflag AS region, CAST(NULL AS VARCHAR) AS size, l_linestatus AS statistic,
       CASE WHEN l_linenumber > 1 THEN l_returnflag || '///' || l_linestatus ELSE '' END AS groups
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
""")
def export_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coordinates file of an export."""
    return export.relations(**_relations(spark, sf_dir))["coordinates"]


@query("SELECT o_custkey AS pmid, o_orderkey AS table_id, o_orderstatus AS table_label, o_orderpriority AS table_caption, '' AS table_foot, 1 AS n_header_rows, 'tables/' || o_custkey || '/' || o_orderkey || '.html' AS table_raw_file FROM orders JOIN customer ON o_custkey = c_custkey")
def export_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables file of an export with HTML."""
    return export.relations(**_relations(spark, sf_dir), table_html=True)["tables"]


WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}')"


@query(f"""
SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY doc_id, term
""")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of ASCII letters, digits and underscores, and their counts in each document."""
    return features.counts(read(spark, sf_dir, "documents"), "doc_id", "text", pattern="[a-z0-9_]{2,}")


@query(f"""
WITH d AS (SELECT * FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)),
c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({WORDS}) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM d)),
w AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM c JOIN f USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w
""")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the terms in two documents or more and at most nine of ten, over labelled documents."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    n = d.count()
    found = features.counts(d, "doc_id", "text", pattern="[a-z0-9_]{2,}")
    w = features.tf_idf(found, "doc_id", n, features.vocabulary(found, n, min_df=2, max_df=0.9))
    return w.select("doc_id", "term", F.round("weight", 9).alias("weight"))


@query("SELECT avg(CAST(l_quantity <> round_even(l_quantity, 0) AS DOUBLE)) AS l_quantity, avg(CAST(l_extendedprice <> round_even(l_extendedprice, 0) AS DOUBLE)) AS l_extendedprice FROM lineitem")
def integer_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of quantities and prices that aren't whole numbers."""
    return qc.non_integer_share(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


@query(f"""
WITH {POINTS.format(s=300)}, v AS (SELECT 'x' AS axis, x AS v FROM p UNION ALL SELECT 'y', y FROM p UNION ALL SELECT 'z', z FROM p),
e AS (SELECT axis, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM v GROUP BY axis),
c AS (SELECT axis, CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n FROM v JOIN e USING (axis) GROUP BY ALL)
SELECT axis, CAST(b AS INT) AS bin, round(lo + b * ((hi - lo) / 50), 6) AS low, coalesce(n, 0) AS n FROM (SELECT axis, lo, hi, unnest(range(0, 50)) AS b FROM e) LEFT JOIN c ON c.axis = e_axis AND c.bin = b
""".replace("SELECT axis, lo, hi, unnest", "SELECT axis AS e_axis, lo, hi, unnest").replace("SELECT axis, CAST(b", "SELECT e_axis AS axis, CAST(b"))
def coord_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty bins of each coordinate from embeddings."""
    return qc.histogram(points(spark, sf_dir), ["x", "y", "z"]).select("axis", "bin", F.round("low", 6).alias("low"), "n")


@query("SELECT c_custkey AS pmid, CASE WHEN o IS NOT NULL THEN 'PMC' || o END AS pmcid, coalesce(n_name, 'UNKNOWN') AS journal FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0")
def id_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the number of their first order, and every second nation's name: lookups with nothing found for some."""
    c = read(spark, sf_dir, "customer")
    pairs = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o")).select(F.col("o_custkey").alias("pmid"), F.concat(F.lit("PMC"), F.col("o").cast("string")).alias("pmcid"))
    journals = c.join(read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("pmid"), F.col("n_name").alias("journal"))
    return retrieval.with_journals(retrieval.with_full_text_ids(c.select(F.col("c_custkey").alias("pmid")), pairs), journals).select("pmid", "pmcid", "journal")


@query("SELECT c_custkey AS pmid FROM customer WHERE c_custkey BETWEEN 20 AND 900 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def range_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a range that have no pending order."""
    on_disk = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("pmid"))
    return retrieval.wanted(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pmid")), on_disk, 20, 900)


@query("""
WITH j AS (SELECT page_id, url, ['Frontiers in Psychology', 'Journal of Cognitive Neuroscience', 'Epilepsia', 'Other'][1 + page_id % 4] AS journal FROM pages),
u AS (SELECT page_id, journal, CASE page_id % 4 WHEN 0 THEN url || '/abstract' WHEN 1 THEN 'http://x.org/doi/abs/' || page_id WHEN 2 THEN 'http://x.org/abstract;session' ELSE CASE WHEN page_id % 8 = 3 THEN 'http://www.sciencedirect.com/' || page_id ELSE url END END AS url FROM j)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, 'abstract$', 'xml/nlm') WHEN 1 THEN replace(url, 'doi/abs', 'doi/full') WHEN 2 THEN 'http://x.org/full' ELSE CASE WHEN contains(url, 'sciencedirect') THEN url || '?np=y' ELSE url END END AS url FROM u
""")
def substitute_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made from pages for four journals, and those of the full texts."""
    p = read(spark, sf_dir, "pages")
    at, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    url = F.when(k == 0, F.concat("url", F.lit("/abstract"))).when(k == 1, F.concat(F.lit("http://x.org/doi/abs/"), at)).when(k == 2, "http://x.org/abstract;session").when(F.col("page_id") % 8 == 3, F.concat(F.lit("http://www.sciencedirect.com/"), at)).otherwise(F.col("url"))
    journal = F.get(F.array(*map(F.lit, ["Frontiers in Psychology", "Journal of Cognitive Neuroscience", "Epilepsia", "Other"])), k.cast("int"))
    return p.select("page_id", url.alias("url"), journal.alias("journal")).select("page_id", T.full_text_url("url", "journal").alias("url"))


@query("SELECT page_id, url FROM pages WHERE NOT contains(lower(url), '/fr/') AND NOT contains(lower(url), 'utm_')")
def skip_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address holds none of the given parts."""
    return read(spark, sf_dir, "pages").where(~T.skips("url", ["/FR/", " utm_ ", "", None])).select("page_id", "url")


_SPACE = {0: "spm", 1: "afni", 2: "mni", 3: "talairach"}


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'MNI' WHEN 1 THEN 'TAL' WHEN 2 THEN 'MNI' WHEN 3 THEN 'TAL' ELSE 'UNKNOWN' END AS space FROM documents")
def space_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line that names a software or a space added by number, and the space guessed."""
    k = F.col("doc_id") % 5
    word = F.when(k == 4, "nothing")
    for i, w in _SPACE.items():
        word = word.when(k == i, w)
    line = F.concat(F.lit("\n" + "we analysed all of our data in " * 2), word, F.lit(" and report the coordinates of all peaks found\n"))
    return read(spark, sf_dir, "documents").select("doc_id", T.guess_space(F.concat("text", line)).alias("space"))


@query("""
SELECT page_id, 'a-b ' || page_id || ' - c' || chr(39) AS decoded FROM pages
""")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with named and odd characters around a page's number, decoded."""
    text = F.concat(F.lit("a&minus;b&nbsp;"), F.col("page_id").cast("string"), F.lit("\xa0–  c Ņ"))
    return read(spark, sf_dir, "pages").select("page_id", T.decode_entities(text).alias("decoded"))


@query("SELECT p_partkey, 'Table ' || p_size AS label, p_name AS caption, CAST(p_size AS VARCHAR) AS number FROM part")
def caption_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions made of a part's size and name, split into label, number and caption."""
    p = read(spark, sf_dir, "part").withColumn("text", F.concat(F.lit("Table "), F.col("p_size").cast("string"), F.lit(". "), "p_name"))
    label, caption = T.split_caption(F.col("text"))
    return p.select("p_partkey", label.alias("label"), caption.alias("caption"), T.first_number(label).alias("number"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS pmid, c_name AS title, 'Journal ' || c_nationkey AS journal, CAST(1990 + c_nationkey AS INT) AS year, 'One, A;Two, B' AS authors, 'First | ' || c_mktsegment AS abstract, '10.1/' || c_custkey AS doi, 'Brain | Humans' AS mesh, 'c' || c_custkey AS citation FROM customer
""")
def metadata_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article metadata in XML made from customers, and its fields."""
    c = read(spark, sf_dir, "customer")
    v = lambda n: F.col(n).cast("string")
    xml = F.concat(
        F.lit('<!DOCTYPE PubmedArticleSet PUBLIC "x" "y"><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">'), v("c_custkey"), F.lit("</PMID><Article><Journal><JournalIssue><PubDate><Year>"), v("year"), F.lit("</Year></PubDate></JournalIssue><Title>Journal "), v("c_nationkey"),
        F.lit("</Title></Journal><ArticleTitle>"), "c_name", F.lit('</ArticleTitle><ELocationID EIdType="pii">q</ELocationID><ELocationID EIdType="doi">10.1/'), v("c_custkey"), F.lit('</ELocationID><Abstract><AbstractText Label="A">First</AbstractText><AbstractText>'), "c_mktsegment",
        F.lit("</AbstractText></Abstract><AuthorList><Author><LastName>One</LastName><ForeName>A</ForeName></Author><Author><CollectiveName>G</CollectiveName></Author><Author><LastName>Two</LastName><ForeName>B</ForeName></Author></AuthorList></Article>"),
        F.lit("<MeshHeadingList><MeshHeading><DescriptorName>Brain</DescriptorName></MeshHeading><MeshHeading><DescriptorName>Humans</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId>a</ArticleId><ArticleId>c"), v("c_custkey"), F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"),
    )
    m = pubmed.metadata(c.withColumn("year", F.col("c_nationkey") + 1990).select(xml.alias("xml")))
    return m.select(*[F.col(f"meta.{k}").alias(k) for k in ("pmid", "title", "journal", "year", "authors", "abstract", "doi", "mesh", "citation")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'PMC' || c_custkey END AS pmcid, CASE WHEN c_custkey % 3 > 0 THEN 'http://p/' || c_custkey END AS url FROM customer")
def link_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link answers in JSON made from customers, one in three without a result: full-text number and provider address."""
    v = F.col("c_custkey").cast("string")
    link = F.when(F.col("c_custkey") % 3 == 1, v).otherwise(F.concat(F.lit("PMC"), v))
    full = F.concat(F.lit('{"linksets":[{"linksetdbs":[{"links":["'), link, F.lit('"]}],"idurllist":[{"objurls":[{"provider":{"nameabbr":"x"},"url":{"value":""}},{"url":{"value":"http://p/'), v, F.lit('"}}]}]}]}'))
    a = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, full).otherwise('{"linksets":[]}').alias("answer"))
    return a.select("c_custkey", pubmed.pmc_id().alias("pmcid"), F.get(pubmed.provider_urls(), F.lit(0)).alias("url"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus = 'F' AS ok, coalesce(sum(CAST(o_orderstatus = 'F' AS INT)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM orders)
SELECT o_orderkey AS rank, ok AS is_new_valid FROM r WHERE n < 100
""")
def take_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by number until a hundred filled ones have been met: a limit that counts only some rows."""
    return retrieval.take_new(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rank"), (F.col("o_orderstatus") == "F").alias("is_new_valid")), 100)


@query("""
WITH h AS (SELECT c_custkey, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS way FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT c_custkey, o_orderkey, way FROM h QUALIFY way = min(way) OVER (PARTITION BY c_custkey)
""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders of the first status, of three in order, that has any."""
    way = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    h = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", way.alias("way"))
    return relational.first_way(h, "c_custkey", "way").select("c_custkey", "o_orderkey", "way")


READABLE_SQL = r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
e AS (SELECT page_id, h, regexp_extract_all(h, '(?s)<(?:p|h1)>(.*?)(?:</p>|</h1>|<br>|</article>)', 1) AS parts FROM b)
SELECT page_id, array_to_string(list_filter([trim(html_unescape) FOR html_unescape IN [replace(replace(replace(replace(regexp_replace(x, '\s*<[^>]*>\s*', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') FOR x IN parts]], lambda x: x <> ''), chr(10) || chr(10)) AS text FROM e
"""


@query(READABLE_SQL)
def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned text of pages: headings and paragraphs, an empty line between."""
    return read(spark, sf_dir, "pages").select("page_id", T.readable("html").alias("text"))


@query(f"""
WITH {POINTS.format(s=300)}, v AS (SELECT * FROM p WHERE {VALID})
SELECT doc AS doc_id, count(*) AS n_activations, '3' AS number, 'Table 3' AS label, 'Peaks of activation' AS caption FROM v GROUP BY doc
""")
def ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text pages with a table of embeddings in a container, some blocked, through the whole ingest: tables with records."""
    t = html_tables(points(spark, sf_dir), "<tr><th>Region</th><th>x</th><th>y</th><th>z</th></tr>", tr(F.concat(F.lit("area "), "label"), *map(F.col, "xyz")))
    before = '<html><head><meta name="ncbi_db" content="pmc"></head><body><div class="table-wrap"><h3>Table 3</h3><div class="caption">Peaks of activation</div><div class="xtable">'
    page = F.concat(F.lit(before), F.regexp_extract("html", "(?s)(<table>.*</table>)", 1), F.lit("</div></div></body></html>"))
    blocked = t.select(F.col("doc_id"), F.concat(F.lit("<title>Redirecting</title>"), page).alias("html"))
    pages = t.select("doc_id", page.alias("html")).union(blocked)
    _, tables, found = ingest.parsed(pages)
    return ingest.with_counts(tables, found).select("doc_id", "n_activations", "number", "label", "caption")
