"""Near-duplicate texts by SimHash and the Jaccard similarity of their word shingles, without a missed pair.

Words are those of `simhash`; a text is the set of the hashes of its shingles. Two texts are linked if their
sets have a Jaccard similarity of 0.8 or more. Texts without words are linked with each other. Equal sets are one node from the start.

SimHash comes first: each set has a fingerprint of its shingles, and pigeonhole blocks (`simhash.links`) give the pairs
of nodes that differ in two bits at most. Such a radius finds only the closest copies: a similarity of 0.8 is about ten differing
bits, for which no blocks select. So the rest of the pairs come from a prefix filter: similar sets of n shingles
share one of the first n - ceil(0.8 n) + 1 shingles of each in any one order of all shingles, and only those are listed.
The order takes shingles first that few texts have, counted over all texts, so that license lines and the like come last;
it decides the cost alone, never the result.

The nodes of a list of up to BUCKET are paired. Two nodes that meet in larger lists alone are both among the crowded nodes, a
minority, whose shingles are counted exactly among themselves. A shingle that no other crowded node has can't be
shared, so a node's size without these bounds its overlap with any other, and rare shingles come first in new lists.
In lists that are still larger than BUCKET, each node is compared with HUBS nodes of the list, those with the fewest shingles of
their own: among copies of one text they are nearest to it. Hubs leave the list, and the next of ROUNDS rounds has others;
after each round what is linked is a component, and lists with a single component are done. In what is left, nodes of
different components are paired if a bound lets them: by what they share with the list's first hub, and have in common with others besides. So a passage's thousands of near copies don't become pairs.
Each candidate is checked on the whole sets; no list is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.llm import simhash
from cellforge.llm.common import arrow_batches, components, stored, temporary
from cellforge.llm.simhash import LOWER, keep_first, majority
from cellforge.llm.url_filter import bloom_filter, probed

WORDS = 5
#: How many texts have a common shingle at least, and how many of these, the most frequent ones, come last in the order.
COMMON, MOST = 3, 400_000
#: Largest list whose pairs are made in a row of its own, how many nodes of a larger one all others are compared with in a round, and rounds.
BUCKET, HUBS, ROUNDS = 16, 4, 1


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a shorter text is one shingle."""
    from xxhash import xxh64_digest

    found = text.translate(LOWER).split()
    if not found:
        return np.zeros(0, np.int64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    n = min(words, len(found))
    starts = np.concatenate([[0], ends[: len(found) - n]]).tolist()
    return np.unique(np.frombuffer(b"".join([xxh64_digest(joined[s:e]) for s, e in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]), np.int64))


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, in order of their hashes, and how many texts have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or b"", words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["s"])

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    with temporary(docs.sparkSession):
        counts = stored(texts.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON), "common")
        # the most frequent ones, by how many there are of each frequency; a table of all isn't sorted for that
        of_each = counts.groupBy(F.least("n", F.lit(1_000)).alias("n")).agg(F.count("*").alias("k")).collect()  # 1,000 rows at most
        least, sum_ = COMMON, 0
        for n, k in sorted(map(tuple, of_each), reverse=True):
            sum_ += k
            if sum_ > MOST:
                least = n + 1
                break
        found = counts.where(F.col("n") >= least).limit(MOST).toArrow()
    s, n = found["s"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefixes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, h (the text's hash), node (the hash of the shingle set), fp (its fingerprint), size and prefix (its first shingles in the common order) of each row."""
    arrow_batches(docs.sparkSession)
    common, times = _common(docs, words)

    def first(s: np.ndarray) -> np.ndarray:
        often = np.zeros(len(s), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            often = np.where(common[at] == s, times[at], 0)
        return s[np.lexsort((s, often))[: len(s) - (4 * len(s) + 4) // 5 + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or b"", words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), _nodes(sets), pa.array([majority(s.tobytes()) if len(s) else 0 for s in sets], pa.int64()), pa.array(map(len, sets), pa.int32()), _lists([first(s) for s in sets])], ["doc_id", "h", "node", "fp", "size", "prefix"])

    return _texts(docs).mapInArrow(run, "doc_id long, h long, node long, fp long, size int, prefix array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").cast("binary").alias("text"))


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    from xxhash import xxh3_64_intdigest

    return pa.array(np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def _lists(x: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *x])))


def _enough(x: str, y: str) -> F.Column:
    """Whether sets of so many shingles, so many of which can be shared, can be similar enough."""
    of = lambda n, k: F.col(f"{n}.{k}")
    return 9 * F.least(of(x, "most"), of(y, "most")) >= 4 * (of(x, "size") + of(y, "size"))


def _sets(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, set) of the nodes whose texts wanted (h) names. The sets are made again, since a table of all would be larger than the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or b"", words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([_nodes(sets), _lists(sets)], ["node", "set"])

    key = F.col("h").cast("string").alias("key")
    bloom, blocks = bloom_filter(wanted.select(key), wanted.count())
    # only texts that the filter lets pass are shuffled; rows that repeat come more than once
    texts = probed(_texts(docs).select("h", "text", key), stored(bloom, "filter"), blocks).where("maybe").select("h", "text")
    return texts.join(wanted, "h", "left_semi").dropDuplicates(["h"]).select("text").mapInArrow(run, "node long, set array<long>")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, same, sizes): how many shingles the sets (node, set) of each pair share and have."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("sizes"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    return _overlaps(pairs, sets).where("9 * same >= 4 * sizes").select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _close(nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes that SimHash brings together: those of one fingerprint with its first node, and of linked fingerprints their first nodes."""
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("b")), "fingerprints")
    same = nodes.join(fps, "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    linked = simhash.links(fps.select("fp")).toDF("x", "y")
    far = linked.join(fps.toDF("x", "a"), "x").join(fps.toDF("y", "b"), "y").select("a", "b")
    return same.union(far)


def _pairs_within(lists: DataFrame) -> DataFrame:
    """(a, b) of nodes that share a list (s, m) of a few and can be similar enough."""
    few = lists.groupBy("s").agg(F.collect_list("m").alias("ms"))
    ok = lambda x, y: (x["node"] < y["node"]) & (9 * F.least(x["most"], y["most"]) >= 4 * (x["size"] + y["size"]))
    pairs = F.flatten(F.transform("ms", lambda x: F.transform(F.filter("ms", lambda y: ok(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x.alias("x"), y.alias("y")))))
    each = few.select(F.explode(pairs).alias("p")).select("p.*")
    # shared up to the last shingle that both prefixes hold are exactly the lists where the two meet; behind it the shorter rest at most
    most = F.count("*") + F.least(F.first("x.size") - F.max("x.pos"), F.first("y.size") - F.max("y.pos")) - 1
    found = each.groupBy("a", "b").agg(most.alias("most"), F.first(F.col("x.size") + F.col("y.size")).alias("sizes"))
    return found.where("9 * most >= 4 * sizes").select("a", "b")


def _crowded(sets: DataFrame) -> DataFrame:
    """(s, m): the lists of crowded nodes (node, set) by their own counts; m is node, size and most (how many of its shingles another one has)."""
    each = sets.select("node", F.explode("set").alias("s"))
    counts = stored(each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "crowded_counts")
    # those that nobody else has come first in the order, and need no rows
    shared = each.join(counts, "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("all"))
    size, most = F.col("size"), F.size("all")
    first = F.slice("all", F.lit(1), F.greatest((most - F.floor((4 * size + 4) / 5) + 1).cast("int"), F.lit(0)))
    known = shared.join(sets.select("node", F.size("set").alias("size")), "node").select("node", "size", most.alias("most"), first.alias("first"))
    # with fewer than 0.8 of its shingles to share, a node can be similar to none
    return known.where("5 * most >= 4 * size").select(F.explode("first.s").alias("s"), F.struct("node", "size", "most").alias("m"))


def _crowded_links(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b) links between crowded nodes (node, set), which connect all that similar pairs connect; found are links that are known."""
    lists = stored(_crowded(sets), "crowded_lists")
    sizes = stored(lists.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "list_sizes")
    lists = stored(lists.join(sizes, "s").select("s", "n", "m"), "met")
    within = lists.where(F.col("n") <= BUCKET).groupBy("s").agg(F.collect_list("m").alias("ms"))
    ok = lambda x, y: (x["node"] < y["node"]) & (9 * F.least(x["most"], y["most"]) >= 4 * (x["size"] + y["size"]))
    within = within.select(F.explode(F.flatten(F.transform("ms", lambda x: F.transform(F.filter("ms", lambda y: ok(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))).alias("p")).select("p.*")
    found = stored(found.union(_similar(_ordered(within), sets)), "linked")
    # a list's first hub is compared with all of its nodes: what they share with it bounds what two of them share
    hot = lists.where(F.col("n") > BUCKET).select("s", "m")
    first = stored(hot.groupBy("s").agg(F.min(F.struct((F.col("m.size") - F.col("m.most")).alias("own"), F.xxhash64(F.lit(-1), "m.node").alias("o"), "m")).alias("f")).select("s", F.col("f.m.node").alias("hub")), "first_hubs")
    hot = hot.join(first, "s")
    known = stored(_overlaps(_ordered(hot.select(F.col("m.node").alias("a"), F.col("hub").alias("b"))), sets), "overlaps")
    found = stored(found.union(known.where("9 * same >= 4 * sizes").select("a", "b")), "linked")
    known = known.select(F.col("a").alias("of"), F.col("b").alias("hub"), "same").union(known.select("b", "a", "same"))
    # the hub itself has no row, and leaves the list
    rooted = hot.join(known, (F.col("m.node") == F.col("of")) & (hot["hub"] == known["hub"])).select("s", F.struct("m.*", "same").alias("m"), F.col("m.node").alias("root"))
    rooted = stored(rooted, "rooted")
    for i in range(ROUNDS):
        # the last one is any node, for lists where several texts meet
        own = F.col("m.size") - F.col("m.most")
        hub = lambda k, own=own: F.min(F.struct((own if k < HUBS - 1 else F.lit(0)).alias("own"), F.xxhash64(F.lit(k), "m.node").alias("o"), "m", "root"))
        hubs = stored(rooted.groupBy("s").agg(F.array(*(hub(k) for k in range(HUBS))).alias("hubs")), "hubs")
        rooted = rooted.join(hubs, "s")
        met = rooted.select("m", "root", F.explode("hubs").alias("hub")).where((F.col("root") != F.col("hub.root")) & _enough("m", "hub.m"))
        rooted = rooted.where(~F.exists("hubs", lambda h: h.m.node == F.col("m.node"))).drop("hubs")
        found = stored(found.union(_similar(_ordered(met.select(F.col("m.node").alias("a"), F.col("hub.m.node").alias("b"))), sets)), "linked")
        roots = components(found).toDF("of", "to")
        rooted = stored(rooted.join(roots, F.col("m.node") == F.col("of"), "left").select("s", "m", F.coalesce("to", "root").alias("root")), "rooted")
        still = stored(rooted.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s"), "open")
        if still.isEmpty():
            return found
        rooted = rooted.join(still, "s")
    # the rest, one component against the others: the largest component of a list isn't paired with itself
    rest = rooted.select("s", F.col("m").alias("x"), F.col("root").alias("p")).join(rooted.select("s", F.col("m").alias("y"), F.col("root").alias("q")), "s")
    # of what two nodes share, one part the hub has too, and of the other part each has what others have besides the hub
    least = lambda f: F.least(f("x"), f("y"))
    most = least(lambda n: F.col(f"{n}.same")) + least(lambda n: F.col(f"{n}.most") - F.col(f"{n}.same"))
    rest = rest.where((F.col("x.node") < F.col("y.node")) & (F.col("p") != F.col("q")) & (9 * most >= 4 * (F.col("x.size") + F.col("y.size"))))
    return found.union(_similar(_ordered(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))), sets))


def links(each: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b) links that connect all nodes of each (h, node, fp, size, prefix) which similar pairs connect."""
    with temporary(docs.sparkSession) as keep:
        with temporary(docs.sparkSession) as own:
            nodes = stored(each.groupBy("node").agg(*(F.first(n).alias(n) for n in ("h", "fp", "size", "prefix"))), "nodes")
            lists = nodes.select(F.posexplode("prefix").alias("pos", "s"), "node", "size")
            # read from a table, the counts are an exchange of their own, and adaptive execution can split a hot shingle
            shared = stored(lists.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s", (F.col("n") > BUCKET).alias("hot")), "shared")
            met = stored(lists.join(shared, "s").select("s", "hot", F.struct("node", "size", "pos", F.col("size").alias("most")).alias("m")), "met")
            pairs = own(_ordered(_pairs_within(met.where("NOT hot")).union(_close(nodes))), "pairs")
            crowded = own(met.where("hot").select(F.col("m.node").alias("node")).distinct(), "crowded_nodes")
            wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded).distinct()
            wanted = own(nodes.select("node", "h").join(wanted, "node", "left_semi").select("h"), "wanted")
        with temporary(docs.sparkSession) as own:
            sets = stored(_sets(wanted, docs, words), "sets")
            found = own(_similar(pairs, sets), "linked")
            crowded = own(sets.join(crowded, "node", "left_semi"), "crowded_sets")
        return keep(_crowded_links(crowded, found), "links")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable) of each row."""
    with temporary(docs.sparkSession) as keep:
        each = stored(prefixes(docs, words), "prefixes")
        roots = components(links(each, docs, words)).withColumnRenamed("node", "of")
        rooted = keep(each.join(roots, F.col("node") == F.col("of"), "left").select("doc_id", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(named, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with one row of each group of near-duplicates, as `simhash.keep_one`."""
    return keep_first(docs, near_duplicates(docs, words))
