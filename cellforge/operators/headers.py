"""Labels, kinds and repeating groups of a table's columns, as expressions over one row for each table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from cellforge.functions import labels as rules

U = "(?dU)"  # \w, \d, \s and \b as in Unicode; a dot matches all but the newline


def raw(cell: Column) -> Column:
    """A position's text, cells that span columns marked with @@."""
    spanned = F.concat(F.lit("@@"), cell.text, F.when(cell.lead, F.concat(F.lit("@"), cell.span.cast("string"))).otherwise(F.lit("")))
    return F.when(cell.span > 1, spanned).otherwise(cell.text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_label(text: Column) -> Column:
    """A position's text as a label: stripped, newlines as tabs, without one final period."""
    return F.regexp_replace(F.translate(strip(F.coalesce(text, F.lit(""))), "\n", "\t"), r"(?Us)\s*\.\z", "")


def can_label(clean: Column) -> Column:
    return (clean != "") & (F.lower(clean) != "empty cell") & ~F.startswith(clean, F.lit("@@"))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_labels(tables: DataFrame) -> DataFrame:
    """tables with labels, the lower-cased label of each column, EMPTY_LABEL where there is none.

    A column's label is its first clean cell. The first column's is `region` instead if by then all others have
    one, or if the cell's row has three runs of digits: then the row is content already.
    """
    t = tables.withColumn("_raw", F.transform("grid", lambda r: F.transform(r, raw)))
    t = t.withColumn("_text", F.transform("_raw", lambda r: F.transform(r, clean_label)))
    t = t.withColumn("_text", F.transform("_text", lambda r: F.transform(r, lambda c: F.when(can_label(c), c))))
    at = lambda j: F.array_position(F.transform("_text", lambda r: F.get(r, j).isNotNull()), True)  # noqa: E731  from 1; 0 if there is none
    t = t.withColumn("_row", F.transform(_upto(F.col("n_cols")), lambda j: at(j).cast("int")))
    others = F.slice("_row", 2, F.greatest(F.size("_row") - 1, F.lit(0)))
    row = F.get("_row", F.lit(0))
    joined = F.array_join(F.transform(F.get("_raw", row - 1), lambda c: F.coalesce(c, F.lit(""))), "/")
    content = F.forall(others, lambda o: (o > 0) & (o < row)) | F.coalesce(F.regexp_like(joined, F.lit(U + r"\d+.*\d+.*\d+")), F.lit(False))
    t = t.withColumn("_content", content)
    label = F.transform("_row", lambda r, j: F.when(r == 0, "EMPTY_LABEL").otherwise(F.lower(F.when((j == 0) & F.col("_content"), "region").otherwise(F.get(F.get("_text", r - 1), j)))))
    return t.withColumn("labels", label).drop("_raw", "_text", "_row", "_content")


def spanning(row: Column) -> Column:
    """(onset, len, text) of a row's cells over several columns."""
    each = F.transform(row, lambda c, j: F.when((c.span > 1) & c.lead, F.struct(j.alias("onset"), c.span.alias("len"), F.translate(c.text, "\n", "\t").alias("text"))))
    return F.filter(each, lambda s: s.isNotNull())


def newest_spans(name: str = "spans") -> Column:
    """Of two cells over the same columns the later one."""
    return F.filter(name, lambda s, i: ~F.exists(F.slice(name, i + 2, F.size(name)), lambda t: (t.onset == s.onset) & (t.len == s.len)))


def with_coordinates(names: Column, over: Column) -> Column:
    """x, y and z as labels under a three-column label that speaks of coordinates, where the labels hold no letter."""
    is_xyz = lambda s: (s.len == 3) & F.regexp_like(s.text, F.lit(U + rules.SPANNED_COORDINATES)) & ~F.regexp_like(F.array_join(F.slice(names, s.onset + 1, s.len), ""), F.lit("[a-zA-Z]"))
    fits = F.filter(over, is_xyz)
    of = lambda i: F.get(F.filter(fits, lambda s: (s.onset <= i) & (i < s.onset + 3)), F.lit(0))
    return F.transform(names, lambda n, i: F.coalesce(F.get(F.array(F.lit("x"), F.lit("y"), F.lit("z")), i - of(i).onset), n))


def alone(label: Column) -> Column:
    """The kind that a label has by itself; z? if that depends on the columns before."""
    has = lambda p: F.regexp_like(label, F.lit(U + p))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, p in rules.BEFORE_COORDINATES:
        out = out.when(has(p), kind)
    for p in rules.TRIPLET:
        out = out.when(has(p), "coord_triplet")
    out = out.when(has(rules.COORDINATES) & ~has(rules.NOT_COORDINATES), "coord_triplet")
    out = out.when(has(rules.AXIS_Y), "y").when(has(rules.AXIS_X), "x").when(has(rules.AXIS_Z), "z?")
    return out.when(has(rules.LATE_TRIPLET), "coord_triplet").when((label == "t") | has(rules.STATISTIC), "statistic").when(has(rules.P_VALUE), "p_value")


def with_kinds(labelled: DataFrame) -> DataFrame:
    """labelled with std, the standard kind of each column or null.

    A label that starts with z is a coordinate only after a y column; else a statistic. All else depends on the
    label alone.
    """
    t = labelled.withColumn("std", F.transform("labels", alone))
    after_y = lambda i: F.coalesce(F.get("std", i - 1) == "y", F.lit(False))
    return t.withColumn("std", F.transform("std", lambda k, i: F.when(k == "z?", F.when(after_y(i), "z").otherwise("statistic")).otherwise(k)))


@pandas_udf(ArrayType(StructType([StructField("onset", IntegerType()), StructField("len", IntegerType())])))
def repeating_groups(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in names:
        yield s.map(lambda x: [{"onset": a, "len": n} for a, n in rules.repeating_groups(list(x))] if x is not None else [])


def infer(tables: DataFrame) -> DataFrame:
    """tables with labels, std, spans (labels over several columns) and groups (columns that repeat)."""
    t = with_labels(tables.withColumn("spans", F.flatten(F.transform("grid", spanning)))).withColumn("spans", newest_spans())
    t = t.withColumn("labels", with_coordinates(F.col("labels"), F.col("spans")))
    return with_kinds(t).withColumn("groups", repeating_groups("labels"))


def columns(inferred: DataFrame) -> DataFrame:
    """The columns relation: doc_id, table_ix, col_ix, label and std."""
    each = inferred.select("doc_id", "table_ix", F.posexplode(F.arrays_zip("labels", "std")).alias("col_ix", "c"))
    return each.select("doc_id", "table_ix", "col_ix", F.col("c.labels").alias("label"), F.col("c.std").alias("std"))


def column_groups(inferred: DataFrame) -> DataFrame:
    """doc_id, table_ix, group_ix, onset, len and group_label of the groups of columns that repeat."""
    each = inferred.select("doc_id", "table_ix", "spans", F.posexplode("groups").alias("group_ix", "g"))
    named = F.get(F.filter("spans", lambda s: (s.onset == F.col("g.onset")) & (s.len == F.col("g.len"))), F.lit(0)).text
    return each.select("doc_id", "table_ix", "group_ix", "g.onset", "g.len", named.alias("group_label"))
