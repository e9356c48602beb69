"""Benchmark decontamination with a distributed positional inverted index.

Texts are lower-cased in A-Z; words are runs of digits, letters and non-ASCII characters. A window is
`width` consecutive words of an item (an item with fewer words, but not none, is one window). The
corpus is counted for the items' words, each window names its two rarest words, and the postings
(word, document, position) of those words are stored. A posting moved back by its word's offset in an
item gives the place where that item would start; lists are intersected by grouping these places, and
a window is a candidate where both of its words are at the same place. For the documents with candidates
the postings of all words follow; the lists of the candidates' other words are intersected in turn, by an equi-join on
document, position and word. Runs of `width` words of an item that a document has in a row are its phrase matches, exactly.
The same postings give the proximity matches: items whose two rarest different words stand near each other.

Only DataFrame operations. All groups are by document and place, document and position, or document and bucket of positions, so that
no key gathers; a document's runs are merged in order. A document's text is shuffled only if a blocked Bloom filter over the
documents with candidates lets it pass. What derives from the items
is broadcast only where its counted rows are at most BROADCAST_ROWS.

Null and empty texts, and texts without words, have no words and no matches; the row stays in the
result. Rows that repeat are judged alike. A null doc_id is kept as a row of its own text. Items that
repeat count once; an item with a null item_id can hit words, but isn't listed or counted. Extra columns
are ignored. Empty tables give an empty result, or no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellforge.llm.common import stored, temporary
from cellforge.llm.url_filter import bloom_filter, probed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words, before upper case is lowered.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 10
#: Rows of item windows or words that are broadcast, at most; beyond, the joins shuffle.
BROADCAST_ROWS = 100_000
NO_ID = -(1 << 63)


def lowered(word: Column) -> Column:
    """A-Z lower-cased, other letters kept."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def pieces(text: str = "text") -> Column:
    """The words of a text, not lowered; the first and last may be empty."""
    return F.split(F.coalesce(F.col(text), F.lit("")), GAP)


def item_words(items: DataFrame) -> DataFrame:
    """item, item_id and words of each distinct item that has words."""
    found = items.select(F.col("item_id"), F.col("text").cast("string")).distinct()
    return found.select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.filter(F.transform(pieces(), lowered), lambda w: w != "").alias("words")).where(F.size("words") > 0)


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and the columns in keep, with the key (d, h) of a row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.struct(F.lit(0).alias("_"), *keep).alias("rest")).select("doc_id", "text", "rest", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"))


def postings(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """(term, d, h, pos) of each occurrence of terms (term) in docs; pos counts from the first piece."""
    each = keyed(docs).select("d", "h", F.posexplode(pieces()).alias("pos", "piece")).select("d", "h", "pos", lowered(F.col("piece")).alias("term"))
    return each.join(_near(terms.select("term"), rows), "term").select("term", "d", "h", "pos")


def counted(docs: DataFrame, words: DataFrame, rows: int) -> DataFrame:
    """(item, o, term, tf): each word of an item, its offset, and how often the corpus has it."""
    spread = words.select("item", F.posexplode("words").alias("o", "term"))
    each = docs.select(F.explode(pieces()).alias("piece")).select(lowered(F.col("piece")).alias("term"))
    counts = each.join(_near(spread.select("term").distinct(), rows), "term").groupBy("term").agg(F.count("*").alias("tf"))
    return spread.join(counts, "term", "left").select("item", "o", "term", F.coalesce("tf", F.lit(0)).alias("tf"))


def anchors(terms: DataFrame, width: int) -> DataFrame:
    """(item, start, n, o1, o2) of each window: its first word, length and the offsets of its two rarest words in the corpus."""
    ranked = terms.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("o", "tf"))).alias("ts"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("ts") - width, F.lit(0)))
    windows = ranked.select("item", F.least(F.size("ts"), F.lit(width)).alias("n"), "ts", F.explode(starts).alias("start"))
    rare = F.slice(F.array_sort(F.transform(F.slice("ts", F.col("start") + 1, F.col("n")), lambda t: F.struct(t.tf, t.o))), 1, 2)
    picked = windows.select("item", "start", "n", rare.alias("r")).where(F.col("r")[0].tf > 0)
    return picked.select("item", "start", "n", F.col("r")[0].o.alias("o1"), F.element_at("r", -1).o.alias("o2"))


def rarest(terms: DataFrame) -> DataFrame:
    """(item, side, term): the two rarest different words that the corpus has, of each item with two."""
    each = terms.where("tf > 0").select("item", "tf", "term").distinct()
    two = each.groupBy("item").agg(F.slice(F.array_sort(F.collect_list(F.struct("tf", "term"))), 1, 2).alias("r")).where(F.size("r") == 2)
    return two.select("item", F.posexplode("r").alias("side", "t")).select("item", "side", "t.term")


def candidates(index: DataFrame, terms: DataFrame, windows: DataFrame, rows: int) -> DataFrame:
    """(d, h, item, place, start, n): windows both of whose rarest words stand where the item, begun at place, has them."""
    # the words that a window is found by: (item, o) to the windows that name it, at most as many as a window has words
    of = windows.select("item", "start", "n", (F.col("o1") != F.col("o2")).alias("two"), F.explode(F.array_distinct(F.array("o1", "o2"))).alias("o"))
    offsets = of.groupBy("item", "o").agg(F.bool_and("two").alias("two"))
    moved = index.join(_near(terms.join(offsets, ["item", "o"]).select("item", "o", "term", "two"), rows), "term")
    moved = moved.select("d", "h", "item", (F.col("pos") - F.col("o")).alias("place"), "o", "two")
    lists = moved.groupBy("d", "h", "item", "place").agg(F.collect_set("o").alias("os"), F.bool_and("two").alias("two")).where((F.size("os") > 1) | ~F.col("two"))
    met = lists.select("d", "h", "item", "place", F.explode("os").alias("o")).join(_near(of, rows), ["item", "o"])
    return met.groupBy("d", "h", "item", "place", "start", "n").agg(F.count("*").alias("found"), F.first("two").alias("two")).where("found = 2 OR NOT two").select("d", "h", "item", "place", "start", "n")


def phrases(found: DataFrame, terms: DataFrame, texts: DataFrame, rows: int) -> DataFrame:
    """(d, h, item, s, e): maximal runs of words in texts (d, h, ps) that hold the windows of found (candidates) and no less."""
    o = F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("o")
    needed = found.select("d", "h", "item", "place", "n", o).distinct().join(_near(terms.select("item", "o", "term"), rows), ["item", "o"])
    needed = needed.select("d", "h", "item", "place", "n", (F.col("place") + F.col("o")).alias("pos"), "term")
    said = texts.select("d", "h", F.posexplode("ps").alias("pos", "piece")).select("d", "h", "pos", lowered(F.col("piece")).alias("term"))
    same = needed.join(said, ["d", "h", "pos", "term"]).select("d", "h", "item", "place", "n", "pos")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("d", "h", "item", "place").orderBy("pos"))
    runs = same.withColumn("run", run).groupBy("d", "h", "item", "place", "run").agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"), F.first("n").alias("n"))
    return runs.where("e - s >= n").select("d", "h", "item", "s", "e").distinct()


def merged(runs: DataFrame) -> DataFrame:
    """(d, h, hit_ranges) of runs (d, h, s, e): those that touch or overlap as one, in order."""
    before = Window.partitionBy("d", "h").orderBy("s", "e")
    far = F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.select("d", "h", "s", "e").distinct().withColumn("new", F.coalesce((F.col("s") > far).cast("int"), F.lit(1)))
    islands = begun.withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0))).groupBy("d", "h", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return islands.groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("hit_ranges"))


def near_items(index: DataFrame, sides: DataFrame, slop: int, rows: int) -> DataFrame:
    """(d, h, item) where the two words of sides (item, side, term) stand within `slop` words, in either order."""
    placed = index.join(_near(sides, rows), "term").select("d", "h", "item", "side", "pos")
    # two places within slop are in one bucket of slop words or in neighbouring ones; of a bucket the first and last place are enough for its neighbours
    bucket = F.floor(F.col("pos") / slop).alias("bucket")
    first = placed.where("side = 0").select("d", "h", "item", bucket, "pos")
    second = placed.where("side = 1").select("d", "h", "item", bucket, "pos")
    own = first.select("d", "h", "item", "bucket").distinct().join(second.select("d", "h", "item", "bucket").distinct(), ["d", "h", "item", "bucket"]).select("d", "h", "item")
    ends = [x.groupBy("d", "h", "item", "bucket").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")) for x in (first, second)]
    after = lambda x, y: x.select("d", "h", "item", F.col("bucket") + 1, "hi").toDF("d", "h", "item", "bucket", "last").join(y, ["d", "h", "item", "bucket"]).where(F.col("lo") - F.col("last") <= slop).select("d", "h", "item")
    return own.union(after(*ends)).union(after(*ends[::-1])).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = (), slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hit_ranges (runs of hit words) of each row, and its columns in keep.

    With slop also n_near: the items whose two rarest different words stand within so many words of each other.
    """
    with temporary(docs.sparkSession) as hold:
        words = stored(item_words(items), "items")
        rows = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
        terms = stored(counted(docs, words, rows), "terms")
        windows = stored(anchors(terms, width), "windows")
        rare = windows.select("item", F.explode(F.array("o1", "o2")).alias("o")).distinct().join(terms, ["item", "o"]).select("term")
        sides = None if slop is None else stored(rarest(terms), "sides")
        index = stored(postings(docs, (rare if sides is None else rare.union(sides.select("term"))).distinct(), rows), "postings")
        found = stored(candidates(index, terms, windows, rows), "candidates")

        # texts without candidates stay where they are
        places = stored(found.select("d", "h").distinct(), "places")
        key = F.concat_ws(" ", "d", "h").alias("key")
        bloom, blocks = bloom_filter(places.select(key), places.count())
        passed = probed(keyed(docs).select("d", "h", "text", key), stored(bloom, "filter"), blocks).where("maybe").drop("key", "maybe")
        passed = passed.join(places, ["d", "h"], "left_semi").dropDuplicates(["d", "h"])
        hits = stored(phrases(found, terms, passed.select("d", "h", pieces().alias("ps")), rows), "phrases")
        ids = hits.join(_near(words.select("item", "item_id"), rows), "item").where("item_id IS NOT NULL").select("d", "h", F.col("item_id").cast("bigint").cast("string").alias("id")).distinct()
        ids = ids.groupBy("d", "h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        judged = merged(hits).join(ids, ["d", "h"], "left")
        if sides is not None:
            met = near_items(index, sides, slop, rows).join(_near(words.select("item", "item_id"), rows), "item").where("item_id IS NOT NULL")
            judged = judged.join(met.groupBy("d", "h").agg(F.count_distinct("item_id").alias("n_near")), ["d", "h"], "full")
        judged = hold(judged, "judged")
        bloom, blocks = bloom_filter(judged.select(key), judged.count())
        bloom = hold(bloom, "judged_filter")

    each = probed(keyed(docs, keep).select("*", key), bloom, blocks)
    none = {"hit_ranges": "array<struct<s:int,e:int>>", "ids": "array<string>", **({} if slop is None else {"n_near": "bigint"})}
    clear = each.where("NOT maybe").select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    each = each.where("maybe").join(judged, ["d", "h"], "left").select(*clear.columns).union(clear).withColumn("ps", pieces())
    # an empty first piece shifts positions by one
    shift = (F.col("ps")[0] == "").cast("int")
    n_words = (F.size("ps") - shift - ((F.size("ps") > 1) & (F.element_at("ps", -1) == "")).cast("int")).cast("long")
    each = each.select("doc_id", "rest", n_words.alias("n_words"), shift.alias("shift"), *(F.coalesce(c, F.lit(0).cast(t) if c == "n_near" else F.array().cast(t)).alias(c) for c, t in none.items()))
    ranges = F.transform("hit_ranges", lambda r: F.struct((r.s - F.col("shift")).alias("s"), (r.e - F.col("shift")).alias("e")))
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda acc, r: acc + r.e - r.s)
    out = [n_hit.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.size("hit_ranges") > 0).alias("contaminated"), ranges.alias("hit_ranges")]
    return each.select("doc_id", "n_words", *out, *([] if slop is None else ["n_near"]), *[F.col(f"rest.{k}") for k in keep if k != "doc_id"])


def proximity(docs: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item_id) where the two rarest different words of an item stand within `slop` words, in either order."""
    words = stored(item_words(items), "items")
    rows = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    sides = stored(rarest(counted(docs, words, rows)), "sides")
    index = stored(postings(docs, sides.select("term").distinct(), rows), "postings")
    met = near_items(index, sides, slop, rows).join(words.select("item", "item_id"), "item")
    return met.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "item_id").distinct()
