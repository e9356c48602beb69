"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of an Arrow batch: texts are long, so the default of 10,000 rows could be a gigabyte.
BATCH_ROWS = 512
#: Connected components stop with an error after so many rounds; the rounds grow with the logarithm of a component's diameter.
MAX_ROUNDS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps the batches that go to Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def with_columns(docs: DataFrame, inputs: list[Column], more: str, make: Callable[[pa.RecordBatch], list[pa.Array]], arrow_rows: int = BATCH_ROWS) -> DataFrame:
    """docs with the columns in more (a schema), which make gives for a batch of the inputs; columns of these names are replaced.

    A row's own columns travel as one struct, so that their names, whatever they hold, aren't resolved again.
    """
    added = _parse_datatype_string(more).fields
    own = [n for n in docs.columns if n not in {f.name for f in added}]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{n.replace('`', '``')}`") for n in own]).alias("row"), *inputs)
    fields = [f for f in docs.schema.fields if f.name in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0)
            yield pa.RecordBatch.from_arrays([*(row.field(i + 1) for i in range(len(own))), *make(b)], [*own, *(f.name for f in added)])

    arrow_batches(docs.sparkSession, arrow_rows)
    return packed.mapInArrow(run, StructType([*fields, *added]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or on one machine (tests) a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="cellforge-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


#: Paths that scratch() gave, by application, in order.
_MADE: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is still there when the driver ends is deleted."""
    path = f"{shared_dir(spark)}/cellforge-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _paths(spark).append(path)
    return path


def _paths(spark: SparkSession) -> list[str]:
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = []
        atexit.register(_forget, spark, app)
    return _MADE[app]


def _forget(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            drop(spark, _MADE.pop(app, []))
    except Exception as e:  # the application ended before its driver did
        print(f"tables of {app} may be left: {type(e).__name__}", file=sys.stderr)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that scratch() named."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at = path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored within are deleted at the end, but for those stored by the function that this gives."""
    paths = _paths(spark)
    before, kept = len(paths), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        kept.append(paths[-1])
        return out

    try:
        yield keep
    finally:
        own = [p for p in paths[before:] if p not in kept]
        paths[before:] = kept
        drop(spark, own)


def made(spark: SparkSession) -> set[str]:
    """The stored tables that are still there."""
    return set(_paths(spark))


def release(spark: SparkSession, tables: set[str], docs: DataFrame) -> None:
    """Deletes tables, if docs is read from files and from none of them: what was derived from them has been written."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    roots = []
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return
        found = leaf.relation().location().rootPaths()
        roots += [found.apply(i).toString() for i in range(found.size())]
    tail = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
    own = _paths(spark)
    if not {tail(r) for r in roots} & {tail(t) for t in tables}:
        drop(spark, [t for t in own if t in tables])
        own[:] = [t for t in own if t not in tables]


#: Whether the shuffle files of a query go when it ends. What is stored is read from its table from then on.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    Later steps survive lost executors and don't compute it again, and its shuffle files go at once.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that links reach.

    Alternates large-star and small-star steps; each is one aggregation of minima with map-side
    combine and one equi-join, so that a node with very many edges never gathers in a task
    (adaptive execution splits the join's hot key). Every round is a table in the shared folder.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # a > b holds in pairs
        if large:  # each neighbour above a node goes to the smallest node around it
            both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            out = pairs.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            # a node above all its neighbours still keeps its link to the smallest of them
            return out.distinct()
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        kept = least.select("a", F.col("m").alias("b"))
        moved = pairs.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return kept.union(moved).distinct()

    def written(df: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, tuple]:
        """The table, and its number of rows and sum of hashes, taken while it is written."""
        seen = Observation()
        out = store(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "round")
        return out, tuple(seen.get.values())

    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    with temporary(edges.sparkSession) as keep:
        pairs, before = written(pairs, stored)
        for _ in range(MAX_ROUNDS):
            with temporary(edges.sparkSession) as own:
                pairs, now = written(star(star(pairs, True), False), own)
            if now == before:
                roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
                return keep(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "roots")
            before = now
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
