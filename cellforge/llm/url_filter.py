"""URL rules behind a blocked Bloom filter.

A rule is an action, a host and a path; it fits its host and all subdomains when the url's path
starts with its path, and the longest fitting rule wins (ties: the longer host, then the greater
text). The keys of the rules (host followed by path) fill a blocked Bloom filter: a key's first
hash names a block of 256 bits, the second sets eight of them. Each url is spelt as the keys that
could fit it, which the filter's block lets pass or not; an exact hash join of those that pass with the
rules then removes the false positives. All of it is DataFrame operations.

A filter of up to INLINE blocks stands in the expression itself: a row without a passing key is judged where it is,
and only rows that pass are shuffled. The blocks of a larger filter are joined with the keys; they are broadcast up to
FILTER_ROWS blocks, for which a longer list gets fewer bits a key and more false positives, and no other result.

The host is what stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; the path
goes on from there to `?`, `#` or the end. A null url, or one without `://`, has an empty host and path
and fits no rule, nor does an empty host. A url that no rule fits is allowed: the filter only
blocks what is listed. Repeated rows are judged alike, extra columns are ignored, and an empty
table, or an empty list, gives an empty result or only allowed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Filter bits for each key; at eight bits set in a block of 256, about one in a thousand keys passes wrongly.
BITS_PER_KEY = 20
#: Blocks of a filter that is part of the expression, and blocks of the largest filter (64 bytes a row when broadcast).
INLINE, FILTER_ROWS = 512, 1_000_000
#: Rules (short keys) and judged addresses are broadcast up to so many rows each.
BROADCAST_ROWS = 20_000


def split_url(url: str | Column = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(u, URL, 1), UPPER, LOWER), F.regexp_extract(u, URL, 2)


def _block(key: str | Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks)).cast("int")


def _bits(key: str | Column) -> list[Column]:
    """Eight bit numbers below 256."""
    h = F.xxhash64(F.lit(2), key)
    return [F.shiftrightunsigned(h, 8 * i).bitwiseAND(255).cast("int") for i in range(8)]


def _masks(key: str | Column) -> list[Column]:
    """Four words with the key's bits."""
    bits = _bits(key)
    words = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for b in bits:
            word = word.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(63))).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return words


def bloom_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(block, w0..w3) of the filter over keys (key), and how many blocks it has room for."""
    blocks = min(max(1, -(-n_keys * BITS_PER_KEY // 256)), FILTER_ROWS)
    masked = keys.select(_block("key", blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks("key"))])
    return masked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def probed(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """rows (key, ...) with maybe: whether the filter lets the key pass. The filter is broadcast, it has FILTER_ROWS rows at most."""
    met = rows.withColumn("_block", _block("key", blocks)).join(F.broadcast(bloom.withColumnRenamed("block", "_block")), "_block", "left")
    of = [F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) == m for i, m in enumerate(_masks("key"))]
    return met.select(*rows.columns, (of[0] & of[1] & of[2] & of[3]).alias("maybe"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url) by rules (action, host, path)."""
    host, path = split_url()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = rules.where("host <> ''").select("action", "host", F.concat("host", "path").alias("key"), F.length("path").alias("path_len"), F.size(F.split("host", r"\.")).alias("labels"))
    listed = listed.groupBy("key").agg(F.max(F.struct("host", "action", "path_len", "labels")).alias("r")).select("key", "r.*").cache()
    facts = listed.agg(F.count("*"), F.collect_set("path_len"), F.max("labels")).first()
    n_rules, lengths, labels = facts[0], sorted(facts[1]), facts[2] or 0
    if not n_rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    near = (lambda df: F.broadcast(df)) if n_rules <= BROADCAST_ROWS else (lambda df: df)

    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    spelt = F.when(F.col("host") != "", F.flatten(F.transform(suffixes, lambda x: F.transform(fits, lambda n: F.concat(x, F.substring("path", F.lit(1), n))))))
    urls = urls.withColumn("keys", F.coalesce(spelt, F.array().cast("array<string>")))

    bloom, blocks = bloom_filter(listed.select("key"), n_rules)
    inline = blocks <= INLINE
    if inline:
        rows = {r.block: r for r in bloom.collect()}  # INLINE rows at most
        words = F.array(*[F.lit(rows[b][f"w{i}"] if b in rows else 0).cast("long") for b in range(blocks) for i in range(4)])

        def passes(key: Column) -> Column:
            def holds(k: Column) -> Column:
                found = F.lit(True)
                for i in range(8):
                    bit = F.shiftrightunsigned(k.h, 8 * i).bitwiseAND(255).cast("int")
                    found = found & (F.call_function("shiftrightunsigned", F.get(words, k.at + F.shiftright(bit, 6)), bit.bitwiseAND(63)).bitwiseAND(1) == 1)
                return found

            # an array of one, so that the hashes are made once
            return F.exists(F.array(F.struct(F.xxhash64(F.lit(2), key).alias("h"), (4 * _block(key, blocks)).alias("at"))), holds)

        urls = urls.withColumn("keys", F.filter("keys", passes))
    # without an inline filter every row may have a rule
    maybe = urls.where(F.size("keys") > 0) if inline else urls
    passed = maybe.select("host", "path", F.explode("keys").alias("key"))
    if not inline:
        passed = probed(passed, bloom, blocks).where("maybe").drop("maybe")
    hits = passed.distinct().join(near(listed.select("key", "action", F.length("host").alias("host_len"))), "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "host_len", "key", "action")).alias("b")).select("host", "path", F.col("b.key").alias("rule"), F.col("b.action").alias("action"))
    judged = maybe.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    if not inline:
        return judged
    clear = urls.where(F.size("keys") == 0)
    return judged.union(clear.select("page_id", "host", "path", F.lit(None).cast("string"), F.lit("allow")))
