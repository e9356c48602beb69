"""SimHash near-duplicates over pigeonhole blocks.

A text is lower-cased in A-Z and split at ASCII white space; its word shingles are hashed with
XXH64 (seed 42), repeats included, and a fingerprint bit is set where it is set in over half of the
hashes. Fewer words than a shingle has make one shingle; no words (null, empty, blank) make
fingerprint zero, which links like any other.

Equal fingerprints are one node from the start, so that groups of exact copies never meet in a
task. Four 16-bit blocks leave at least two untouched by two differing bits: each fingerprint goes
to the six pairs of blocks, and fingerprints that share a pair are verified by Hamming distance. A
bucket of up to BUCKET fingerprints is verified pair by pair. A larger one (thousands of near copies,
or an unlucky block) is verified exactly without pairs: each member is listed under itself and its
64 one-bit neighbours, and two fingerprints differ in at most two bits if and only if they share one
of these keys, which at most 65 fingerprints can share. No bucket is cut.

Rows with a null doc_id count as texts, but can't name a component; rows that repeat are linked by
their equal fingerprints. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.llm.common import arrow_batches, components, stored, temporary

#: Largest bucket that is verified pair by pair.
BUCKET = 64
#: Largest Hamming distance that the two ways of verifying are built for.
BITS = 2
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: BYTE_BITS[b] has the bits of byte b, highest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text as a signed 64-bit integer."""
    from xxhash import xxh64_digest

    found = text.translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = xxh64_digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate([[0], ends[:-words]]).tolist()
        ends = (ends[words - 1 :] - 1).tolist()
        hashes = b"".join([xxh64_digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)])
    return majority(hashes)


def majority(hashes: bytes) -> int:
    """The bits that are set in over half of the 64-bit hashes (big-endian), as a signed integer."""
    columns = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(columns)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"", words, seed) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _block_keys() -> F.Column:
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    return F.array(*[F.lit(t << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for t, (i, j) in enumerate(pairs)])


def links(fps: DataFrame) -> DataFrame:
    """(a, b) links between the distinct fingerprints in fps (fp) at BITS differing bits or fewer.

    Every linked pair is connected by the links, though not each pair has a row of its own.
    """
    keyed = fps.select("fp", F.explode(_block_keys()).alias("key"))
    # read from a table, the counts are an exchange of their own, and adaptive execution can split a crowded bucket
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = stored(keyed.join(shared, "key"), "blocks")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= BITS
    small = met.where(F.col("n") <= BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.explode(F.flatten(F.transform("fps", lambda x, i: F.transform(F.filter(F.col("fps"), lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*")
    around = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64))]
    hot = met.where(F.col("n") > BUCKET).select("fp").distinct().select("fp", F.explode(F.array(*around)).alias("key"))
    stars = hot.groupBy("key").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).select(F.explode("fps").alias("a"), "b").where((F.col("a") != F.col("b")) & near(F.col("a"), F.col("b")))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of each row."""
    each = stored(fingerprints(docs, words, seed), "fingerprints")
    fps = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    with temporary(docs.sparkSession) as keep:
        roots = keep(components(links(fps.select("fp"))), "roots")
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return each.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest doc_id.

    Rows of equal doc_id and text are one document. Rows with a null doc_id go where their group has a
    document with an id, and stay otherwise.
    """
    return keep_first(docs, near_duplicates(docs, words, seed))


def keep_first(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs that judged (doc_id, component_id) names a component by, once each."""
    first = judged.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col("row.doc_id").alias("d"), F.xxhash64("row.text").alias("h"))
    kept = rows.join(first, F.col("d").eqNullSafe(F.col("first")), "left_semi")
    return kept.dropDuplicates(["d", "h"]).select("row.*")
