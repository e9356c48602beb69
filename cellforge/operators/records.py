"""Grid rows to records: kinds of rows, headings carried down, unpivoted groups, and one record's attributes.

All of it is expressions over rows that come from exploding a table's own arrays, so a record needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellforge.config import DEFAULTS, Settings
from cellforge.operators.headers import U, infer, raw, strip

# Characters that count as a minus sign, and what a number and a triplet look like.
DASHES = "֊‐‑⁃﹣－‒–—﹘−"
NUMBER = r"([-]?\d{1,3}\.?\d{0,2})"
TRIPLET = U + r"\n*" + r"[,;\s]+".join([NUMBER] * 3)
STRAY_PERIOD = U + r"(?<!\d)\.(?!\d)"
SPACED_MINUS = U + r"^-\s?(\d+\.*\d*)$"
COORDINATE = U + r"^[-]*\d+\.*\d*$"
#: Coordinates are smaller than this in magnitude.
LIMIT = 100
ATTRIBUTES = ("region", "hemisphere", "ba", "size", "statistic", "p_value")
AXES = ("x", "y", "z")


def one_dash(text: Column) -> Column:
    """Dashes of all kinds as hyphens, two in a row as one."""
    return F.replace(F.translate(text, DASHES, "-" * len(DASHES)), F.lit("--"), F.lit("-"))


def to_number(text: Column) -> Column:
    return F.rtrim(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("--"), F.lit("-")), F.lit(".")).try_cast("double")


def triplet(text: Column) -> Column:
    """The first three numbers in a row of a text, as an array of doubles, or null."""
    clean = F.regexp_replace(text, STRAY_PERIOD, "")
    return F.when(F.regexp_like(clean, F.lit(TRIPLET)), F.array(*[to_number(F.regexp_extract(clean, TRIPLET, k)) for k in (1, 2, 3)]))


def coordinate(text: Column) -> Column:
    """A single coordinate as a double, or null if the text isn't one; a space after the minus sign is allowed."""
    joined = F.when(F.regexp_like(text, F.lit(SPACED_MINUS)), F.concat(F.lit("-"), F.regexp_extract(text, SPACED_MINUS, 1))).otherwise(text)
    return F.when(F.regexp_like(joined, F.lit(COORDINATE)), joined.try_cast("double"))


def row_kinds(inferred: DataFrame) -> DataFrame:
    """inferred with rows: (vals, kind, heading) of each grid row; kinds are width, header, group, span and data."""
    vals = lambda r: F.transform(r, lambda c: strip(raw(c)))
    rows = F.transform("grid", lambda r: F.struct(F.get(r, F.lit(0)).alias("head"), vals(r).alias("vals")))
    n = F.size("labels")

    def kind(r: Column) -> Column:
        first, rest = F.get(r.vals, F.lit(0)), F.slice(r.vals, 2, F.greatest(F.size(r.vals) - 1, F.lit(0)))
        head = r.head
        return (
            F.when(F.exists(r.vals, lambda v: v.isNull()) | (F.size(r.vals) != n), "width")
            .when(F.exists(F.zip_with(r.vals, F.col("labels"), lambda v, x: v == x), lambda same: same), "header")
            .when((first != "") & F.forall(rest, lambda v: v == ""), "group")
            .when((head.span > 1) & head.lead & (head.span == F.col("n_cols")), "group")
            .when(F.exists(r.vals, lambda v: F.contains(v, F.lit("@@"))), "span")
            .otherwise("data")
        )

    heading = lambda r, k: F.when(k == "group", F.when(r.head.span > 1, strip(r.head.text)).otherwise(F.get(r.vals, F.lit(0))))
    return inferred.withColumn("rows", rows).withColumn("row_kinds", F.transform("rows", kind)).withColumn("rows", F.zip_with("rows", "row_kinds", lambda r, k: F.struct(r.vals.alias("vals"), k.alias("kind"), heading(r, k).alias("heading")))).drop("row_kinds")


def carry_down(kinds: DataFrame) -> DataFrame:
    """One row for each data row: row_ix, vals and heading, the text of the last group row above it."""
    above = F.transform("rows", lambda r, i: F.struct(i.cast("int").alias("row_ix"), r.vals.alias("vals"), r.kind.alias("kind"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(F.slice("rows", 1, i), lambda q: q.heading), lambda h: h.isNotNull())), -1).alias("heading")))
    kept = F.filter(above, lambda r: r.kind == "data")
    each = kinds.withColumn("r", F.explode(kept)).drop("rows", "grid")
    return each.select("*", "r.row_ix", "r.vals", "r.heading").drop("r")


def candidates(data: DataFrame) -> DataFrame:
    """One row for each record that a data row may hold: group_ix, entries (label, std, text) and record_groups.

    Without repeating groups the row is one candidate; else each group gives one, of its columns and of those in no group.
    """
    entry = F.transform(F.sequence(F.lit(0), F.size("vals") - 1), lambda i: F.struct(F.get("labels", i).alias("label"), F.get("std", i).alias("std"), F.get("vals", i).alias("text"), i.alias("i")))
    within = lambda i, g: (g.onset <= i) & (i < g.onset + g.len)
    none = F.array(F.struct(F.lit(None).cast("int").alias("onset"), F.lit(None).cast("int").alias("len")))
    each = data.withColumn("entries", entry).withColumn("all_groups", F.col("groups")).withColumn("g", F.explode(F.transform(F.when(F.size("groups") > 0, F.col("groups")).otherwise(none), lambda g, k: F.struct(k.cast("int").alias("group_ix"), g.onset.alias("onset"), g.len.alias("len")))))
    own = F.filter("entries", lambda e: F.col("g.onset").isNull() | within(e.i, F.col("g")) | ~F.exists("all_groups", lambda g: within(e.i, g)))
    named = F.transform(F.filter("spans", lambda s: (s.onset == F.col("g.onset")) & (s.len == F.col("g.len"))), lambda s: s.text)
    heading = F.when(F.col("heading").isNull(), F.array().cast("array<string>")).otherwise(F.array("heading"))
    groups = F.when(F.col("g.onset").isNull(), heading).otherwise(F.concat(named, heading))
    return each.select("doc_id", "table_ix", "row_ix", F.col("g.group_ix").alias("group_ix"), own.alias("entries"), groups.alias("record_groups"))


def attributes(found: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The record of each candidate: x, y, z, the attributes, groups, columns and problems.

    Entries are read from left to right, the last one that sets something wins. An axis entry that isn't a number ends
    the record: later entries and the groups are left out. Three numbers in any entry set all axes.
    """
    text = F.transform("entries", lambda e: F.struct(e.label.alias("label"), e.std.alias("std"), one_dash(e.text).alias("text")))
    in_coords = lambda e: F.coalesce(e.std.isin("coord_triplet", *AXES), F.lit(False))
    is_axis = lambda e: F.coalesce(e.std.isin(*AXES), F.lit(False))
    tries = (lambda e: F.lit(True)) if settings.strict_parity else (lambda e: in_coords(e) | e.std.isNull())
    read = F.transform("e", lambda e, i: F.struct(i.cast("int").alias("i"), e.label.alias("label"), e.std.alias("std"), e.text.alias("text"), F.when(tries(e), triplet(e.text)).alias("xyz"), F.when(is_axis(e), coordinate(e.text)).alias("one")))
    r = found.withColumn("e", text).withColumn("e", read)
    # the first triplet in a coordinate column excuses blank axis entries to its right
    since = F.coalesce(F.array_min(F.transform(F.filter("e", lambda e: in_coords(e) & e.xyz.isNotNull()), lambda e: e.i)), F.lit(1 << 30))
    r = r.withColumn("since", since)
    blank = lambda e: (e.i > F.col("since")) & (F.trim(e.text) == "")
    bad = lambda e: is_axis(e) & e.xyz.isNull() & e.one.isNull() & ~blank(e)
    r = r.withColumn("bad", F.get(F.filter("e", bad), F.lit(0)))
    r = r.withColumn("e", F.when(F.col("bad").isNull(), F.col("e")).otherwise(F.slice("e", 1, F.col("bad.i"))))
    last = lambda kept, value: F.element_at(F.concat(F.array(F.lit(None)), F.transform(F.filter("e", kept), value)), -1)
    axis = lambda k, a: last(lambda e: e.xyz.isNotNull() | ((e.std == a) & e.one.isNotNull()), lambda e: F.when(e.xyz.isNotNull(), F.get(e.xyz, F.lit(k))).otherwise(e.one))
    named = lambda a: last(lambda e: e.std == a, lambda e: e.text)
    pairs = F.transform("e", lambda e: F.struct(e.label.alias("k"), F.when(e.one.isNotNull() & e.xyz.isNull(), e.one.cast("string")).otherwise(e.text).alias("v")))
    newest = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.k == p.k))
    odd = F.transform(F.filter("e", lambda e: (e.std == "region") & ~F.regexp_like(e.text, F.lit("[a-zA-Z]"))), lambda e: F.lit("Value in region column is not a string"))
    wrong = F.when(F.col("bad").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.format_string("Value in %s column is not valid", "bad.std")))
    record = F.struct(
        *[axis(k, a).alias(a) for k, a in enumerate(AXES)], *[named(a).alias(a) for a in ATTRIBUTES],
        F.when(F.col("bad").isNull(), F.col("record_groups")).otherwise(F.array().cast("array<string>")).alias("groups"), F.map_from_entries(newest).alias("columns"), F.concat(odd, wrong).alias("problems"),
    )
    # out of an array of one, the record is made once; a filter on it would else be pushed down and make it again
    return r.select("doc_id", "table_ix", "row_ix", "group_ix", F.explode(F.array(record)).alias("r")).select("doc_id", "table_ix", "row_ix", "group_ix", "r.*")


def is_valid(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """All three coordinates there and below LIMIT in magnitude, and fewer than two of them zero."""
    c = [F.col(k) for k in (x, y, z)]
    zeros = sum(((k == 0).cast("int") for k in c), F.lit(0))
    return F.coalesce(c[0].isNotNull() & c[1].isNotNull() & c[2].isNotNull() & (F.greatest(*[F.abs(k) for k in c]) < LIMIT) & (zeros < 2), F.lit(False))


def all_records(tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every candidate record of tables (doc_id, table_ix, n_cols, grid), valid or not."""
    inferred = infer(tables.select("doc_id", "table_ix", "n_cols", "grid"))
    if settings.exclude_unlabelled:
        inferred = inferred.where(~F.array_contains("labels", "EMPTY_LABEL"))
    return attributes(candidates(carry_down(row_kinds(inferred))), settings)


def records(tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The valid records of tables."""
    return all_records(tables, settings).where(is_valid())
