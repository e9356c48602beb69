"""Set operations of the store: what is new, what is best, what is kept together, and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_only(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet."""
    return rows.join(stored.select(key), key, "left_anti")


def upsert(stored: DataFrame, rows: DataFrame, key: str, overwrite: bool) -> DataFrame:
    """stored with rows: those of stored keys replace what is stored, or are left out."""
    if overwrite:
        return stored.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)
    return stored.unionByName(new_only(rows, stored, key))


def without(relations: dict[str, DataFrame], keys: DataFrame, key: str = "article_id") -> dict[str, DataFrame]:
    """All relations without the articles in keys and what belongs to them."""
    return {n: df.join(keys.select(F.col(key).alias("id" if n == "articles" else key)), "id" if n == "articles" else key, "left_anti") for n, df in relations.items()}


def best(candidates: DataFrame, key: str, score: list[Column], tie: Column | str) -> DataFrame:
    """One row for each key: that of the greatest score, then of the smallest tie value.

    A maximum of structs is combined before the shuffle, so a key with any number of candidates is no large group.
    """
    cols = [F.col(c) for c in candidates.columns]
    ranks = [s.alias(f"s{i}") for i, s in enumerate(score)]
    tied = candidates.select(F.col(key).alias("_k"), F.struct(*ranks).alias("_s"), (F.col(tie) if isinstance(tie, str) else tie).alias("_t"), F.struct(*cols).alias("_r"))
    top = tied.groupBy("_k").agg(F.max("_s").alias("_s"))
    first = tied.join(top, (tied["_k"].eqNullSafe(top["_k"])) & (tied["_s"] == top["_s"]), "left_semi")
    return first.groupBy("_k").agg(F.min_by("_r", "_t").alias("_r")).select("_r.*")


def quality(n_records: Column | str, n_tables: Column | str, missing: Column | str) -> list[Column]:
    """The score of a parsed page: records, tables, no missing source, any table; pages that weren't parsed come last."""
    r, t, m = (F.col(c) if isinstance(c, str) else c for c in (n_records, n_tables, missing))
    return [F.coalesce(r, F.lit(-1)), F.coalesce(t, F.lit(-1)), F.coalesce(-m.cast("int"), F.lit(-1)), F.coalesce((t > 0).cast("int"), F.lit(-1))]


def with_children(parents: DataFrame, key: str, *children: tuple[DataFrame, str]) -> DataFrame:
    """Parents that have a row in any of the (relation, foreign key) children."""
    marks = []
    out = parents
    for i, (child, fk) in enumerate(children):
        mark = child.select(F.col(fk).alias(f"_k{i}")).distinct().withColumn(f"_m{i}", F.lit(True))
        out = out.join(mark, F.col(key) == F.col(f"_k{i}"), "left")
        marks.append(F.coalesce(F.col(f"_m{i}"), F.lit(False)))
    return out.where(reduce(Column.__or__, marks)).select(*parents.columns)


def store_stats(articles: DataFrame, tables: DataFrame, records: DataFrame, links: DataFrame) -> DataFrame:
    """One row: articles, those with records, tables, records, links, and articles with links."""
    n = lambda df, name, what=None: df.agg((what if what is not None else F.count("*")).cast("long").alias(name))
    parts = [n(articles, "n_articles"), n(tables.where("n_activations > 0"), "n_articles_with_records", F.count_distinct("article_id")), n(tables, "n_tables"), n(records, "n_records"), n(links, "n_links"), n(links, "n_articles_with_links", F.count_distinct("article_id"))]
    return reduce(lambda a, b: a.join(b), parts)  # one row each


def first_way(hits: DataFrame, key: str, rank: str) -> DataFrame:
    """Of each key's rows those of its smallest rank: the first way that found any."""
    least = hits.groupBy(key).agg(F.min(rank).alias("_least"))
    return hits.join(least, key).where(F.col(rank) == F.col("_least")).drop("_least")


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of smallest order among rows of equal keys; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


#: Ranges of the order over which `up_to` counts.
RANGES = 256


def up_to(rows: DataFrame, order: str, counts: str, most: int) -> DataFrame:
    """Rows in order of a number until `most` of those that count have been met.

    The running count is made in two steps, within ranges of the order and over the ranges' sums, so that no
    task sees all rows. The ranges' bounds are quantiles of the order, so a row's range depends on its order alone.
    """
    bounds = rows.agg(F.percentile_approx(order, F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(10_000))).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(order))) if bounds else F.lit(0)
    spread = rows.withColumn("_part", part)
    counted = F.col(counts).cast("long")
    sums = spread.groupBy("_part").agg(F.sum(counted).alias("_n"))
    ahead = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))  # RANGES rows
    run = spread.withColumn("_own", F.sum(counted).over(Window.partitionBy("_part").orderBy(order))).join(F.broadcast(ahead), "_part")
    # the row that brings the count to `most` is the last one
    return run.where((F.col("_ahead") + F.col("_own") - counted) < most).drop("_part", "_own", "_ahead")
