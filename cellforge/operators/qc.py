"""Quality checks of numeric columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def non_integer_share(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of values of each column that aren't whole numbers."""
    return rows.agg(*[F.avg((F.col(c) != F.rint(c)).cast("double")).alias(c) for c in columns])


def histogram(rows: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """(axis, bin, low, high, n) of bins of equal width between a column's least and greatest value; the last bin is closed."""
    wide = rows.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))])
    long = lambda c: wide.select(F.lit(c).alias("axis"), F.col(f"min_{c}").cast("double").alias("lo"), F.col(f"max_{c}").cast("double").alias("hi"))
    ends = reduce(DataFrame.union, [long(c) for c in columns])
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*").where("v IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counted = values.join(F.broadcast(ends), "axis").groupBy("axis", at.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counted, ["axis", "bin"], "left").select("axis", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
