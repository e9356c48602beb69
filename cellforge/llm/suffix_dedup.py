"""Removal of repeated byte strings with a sparse, distributed enhanced suffix array.

Every byte covered by a string of `least` bytes that starts at two places or more of the input is
removed. Texts are whole UTF-8 bytes; matches never cross texts.

1. Anchors. In each window of `least` bytes the GRAM-byte strings of smallest hash are anchors, chosen by
   content alone: equal windows have equal anchors at equal offsets. One position in about 140 is one.
   An anchor's context is what a window around it can reach: up to least-GRAM bytes before it and
   least bytes from it. Two windows at an anchor are equal if and only if the contexts agree over them.
2. Equal contexts are counted with map-side combine, so that copies by the thousand are one row. A
   context that occurs twice is repeated as a whole; only different contexts of one anchor string are
   compared, each by one representative.
3. Suffix arrays. The contexts of an anchor string are sorted from the anchor on; a scan of the array of
   common prefixes with a stack yields the tree of common-prefix intervals. In each interval the left
   contexts are sorted and scanned too, and left-extension diversity splits the members into maximal
   repeat groups with all their occurrences: members share depth + left extension >= least bytes, and
   not all of them a byte more on either side. `maximal_repeats` lists the groups; for the removal they
   give each context the reach (bytes before and after its anchor) that is repeated.
4. An anchor string with more than GROUP different contexts (a passage in very many texts) isn't gathered in
   a task. Its contexts are refined by counting: cells of 32, then 8, then single window offsets
   are kept while their common core occurs in two contexts; what is left are exactly the windows
   that repeat. Counts are map-side combined, so nothing gathers, and nothing is cut or sampled.
5. The reaches go back to all places of a context, are merged per text and cut out. Texts are shuffled only
   where a Bloom filter lets them pass: to take contexts from them, and to cut them.

Null and empty texts keep all their (zero) bytes. A row's key is its doc_id and its text, so rows that
repeat are two places of each string and are judged alike; a null doc_id is a key too. Extra columns
are ignored by `removals` and kept by `cut_repeats`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.llm.common import arrow_batches, stored, temporary
from cellforge.llm.url_filter import bloom_filter, probed

LEAST, GRAM = 400, 128
#: Runs of so short a period give anchors only to the windows within them.
PERIOD = 32
#: Different contexts of one anchor string that are sorted in one task, at most.
GROUP = 4_000
#: Contexts that a worker sorts at once (a few groups more), and bytes that it hashes at once.
CHUNK_ROWS, CHUNK_BYTES = 8_192, 1 << 20
#: Parts of a long text overlap by so many bytes: all windows, and the runs around them, are whole in one of them.
OVERLAP = 4_096
#: Widths of the cells of window offsets.
CELLS = (32, 8, 1)
NO_ID = -(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each byte, and the powers of an odd number and of its inverse modulo 2**64."""
    r = 0xD1342543DE82EF95
    n = CHUNK_BYTES + 2 * LEAST
    power = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]), dtype=np.uint64)
    return np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64), power(r), power(pow(r, -1, 1 << 64))


def _sliding(x: np.ndarray, width: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """ufunc over each `width` consecutive values of x (block-wise running values from both sides)."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, fill, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    back = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[: n - width + 1], ahead[width - 1 : n])


def periodic_runs(buffer: np.ndarray, sums: np.ndarray, gram: int = GRAM) -> list[tuple[int, int]]:
    """Maximal runs of period gram / 4 (PERIOD at most) or less and of gram bytes or more, in order.

    In such a run the smallest hash of half a gram comes again one period later, and in its first place all places
    that it is compared with lie in the run: whether a run is found doesn't depend on what stands around it.
    """
    period = min(PERIOD, gram // 4)
    half = 2 * period
    n = len(buffer)
    h = _hashes(sums, half)
    if len(h) <= period + 1:
        return []
    ahead = _sliding(h[1:], period, np.minimum, (1 << 64) - 1)
    ties = np.flatnonzero(h[: len(ahead)] == ahead)
    if not len(ties):
        return []
    ahead = h[ties[:, None] + np.arange(1, period + 1)[None]] == h[ties][:, None]
    found, done = [], -1
    for i, d in zip(ties.tolist(), (ahead.argmax(1) + 1).tolist(), strict=True):
        if i + half <= done:
            continue
        s, e, step = i, i + half, 256
        while e < n:  # forward while each byte equals the one a period before
            q = min(step, n - e)
            differ = buffer[e : e + q] != buffer[e - d : e - d + q]
            k = int(differ.argmax()) if differ.any() else q
            e += k
            if k < q:
                break
            step *= 4
        step = 256
        while s > 0:
            q = min(step, s)
            differ = (buffer[s - q : s] != buffer[s - q + d : s + d])[::-1]
            k = int(differ.argmax()) if differ.any() else q
            s -= k
            if k < q:
                break
            step *= 4
        done = e
        if e - s >= gram:
            found.append((s, e))
    return found


def _hashes(sums: np.ndarray, gram: int) -> np.ndarray:
    _, _, down = _tables()
    h = (sums[gram:] - sums[:-gram]) * down[: len(sums) - gram]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _anchors(buffer: np.ndarray, spans: list[tuple[int, int]], least: int, gram: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Positions and hashes of the anchors of windows that lie within one of spans, and the periodic runs.

    A gram within a periodic run comes after all others: its hash has the highest bit.
    """
    word, up, _ = _tables()
    n = len(buffer)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(word[buffer] * up[:n], out=sums[1:])
    h = _hashes(sums, gram) >> np.uint64(1)
    runs = periodic_runs(buffer, sums, gram) if gram >= 2 * PERIOD else []
    for s, e in runs:
        h[s : e - gram + 1] |= np.uint64(1 << 63)
    width = least - gram + 1
    low = _sliding(h, width, np.minimum, (1 << 64) - 1)
    valid = np.zeros(len(low), bool)
    for s, e in spans:
        valid[s : e - least + 1] = True
    low[~valid] = 0
    edge = np.zeros(width - 1, np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), width, np.maximum, 0)
    at = np.flatnonzero((h == high) & (high != 0))
    return at, h[at], runs


def anchors_of(texts: list[bytes], least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, positions, hashes, starts, ends) of the anchors of each text, with the range of their contexts.

    Long texts go through in overlapping parts; an anchor of two parts is one.
    """
    held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for found in _part_anchors(texts, least, gram):
        if held and held[0][0] != found[0]:
            yield _one_each(held)
            held = []
        held.append(found)
    if held:
        yield _one_each(held)


def _one_each(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a text's parts, one for each position; runs that a part's end cuts reach as far as in either part."""
    if len(parts) == 1:
        return parts[0]
    at, h, first, last = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
    order = np.lexsort((h, at))
    at, h, first, last = at[order], h[order], first[order], last[order]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (h[1:] != h[:-1])])) if len(at) else np.zeros(0, int)
    if len(new) == len(at):
        return parts[0][0], at, h, first, last
    return parts[0][0], at[new], h[new], np.minimum.reduceat(first, new), np.maximum.reduceat(last, new)


def _part_anchors(texts: list[bytes], least: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As `anchors_of`, for each part of a text in turn."""
    pack: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        ends = np.cumsum([len(p[2]) for p in pack]).tolist()
        starts = [0, *ends[:-1]]
        at, h, runs = _anchors(np.frombuffer(b"".join(p[2] for p in pack), np.uint8), list(zip(starts, ends, strict=True)), least, gram)
        cuts = np.searchsorted(at, [*starts, ends[-1]])
        run_starts, run_ends = (np.array([r[k] for r in runs], np.int64) for k in (0, 1))
        for (i, off, _), s, e, lo, hi in zip(pack, starts, ends, cuts[:-1], cuts[1:], strict=True):
            p, g = at[lo:hi], h[lo:hi]
            n = len(texts[i]) - off + s
            first, last = np.maximum(p - (least - gram), s - off), np.minimum(p + least, n)
            if len(runs) and (odd := g >= 1 << 63).any():
                # windows with such an anchor lie within its run; the part's own ends bound runs here
                k = np.searchsorted(run_starts, p[odd], side="right") - 1
                first[odd] = np.maximum(np.maximum(run_starts[k], first[odd]), s)
                last[odd] = np.minimum(np.minimum(run_ends[k], last[odd]), e)
            yield i, p - s + off, g, first - s + off, last - s + off

    for i, t in enumerate(texts):
        if len(t) < least:
            continue
        for off in range(0, max(len(t) - OVERLAP, 1), CHUNK_BYTES - OVERLAP):
            part = t[off : off + CHUNK_BYTES]
            if pack and size + len(part) > CHUNK_BYTES:
                yield from flush()
                pack, size = [], 0
            pack.append((i, off, part))
            size += len(part)
    if pack:
        yield from flush()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_h", F.xxhash64(F.col("text").cast("string"))).withColumn("_text", F.col("text").cast("string").cast("binary"))


def anchor_table(docs: DataFrame, least: int, gram: int, every: bool = False) -> DataFrame:
    """(d, h, pos, before, after, a, c, n): the anchors of each text, with the hash a of the anchor string and c of its context.

    Equal contexts of a text are one row with n = 2, and rows without a that say which bytes they cover; with `every` each is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            ds, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, at, h, first, last in anchors_of(texts, least, gram):
                t = texts[i]
                c = np.array([xxh3_64_intdigest(t[x:y], seed) for x, y, seed in zip(first.tolist(), last.tolist(), (at - first).tolist(), strict=True)], np.uint64)
                if every:
                    one, n, twice = np.arange(len(at)), np.ones(len(at), int), np.zeros(len(at), bool)
                else:
                    _, one, again, n = np.unique(np.stack([h, c]), axis=1, return_index=True, return_inverse=True, return_counts=True)
                    twice = n[again.ravel()] > 1
                local = merge([{"s": x, "e": y} for x, y in zip(first[twice].tolist(), last[twice].tolist(), strict=True)])
                size = len(one) + len(local)
                ends = np.array(local, np.int64).reshape(-1, 2)
                cols = [np.full(size, ds[i]), np.full(size, hs[i])]
                cols += [np.concatenate([x, y]).astype(np.int32) for x, y in ((at[one], ends[:, 0]), ((at - first)[one], ends[:, 0] * 0), ((last - at)[one], ends[:, 1] - ends[:, 0]))]
                keys = [pa.array(np.concatenate([x[one].view(np.int64), ends[:, 0] * 0]), mask=np.arange(size) >= len(one)) for x in (h, c)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *keys, pa.array(np.concatenate([np.minimum(n, 2), ends[:, 0] * 0]).astype(np.int32))], ["d", "h", "pos", "before", "after", "a", "c", "n"])

    arrow_batches(docs.sparkSession, 256)
    return keyed(docs).select("_d", "_h", "_text").where(F.length("_text") >= least).mapInArrow(run, "d long, h long, pos int, before int, after int, a long, c long, n int")


def prefix_intervals(lcp: list[int], least: int = 1) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each common-prefix interval of depth `least` or more, children first; lcp[i] is shared by entries i-1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) and lcp[i] >= least else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def _common(m: np.ndarray, lens: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes rows x and y of m share from the start."""
    differ = m[x] != m[y]
    n = np.where(differ.any(1), differ.argmax(1), m.shape[1]) if m.shape[1] else np.zeros(len(x), int)
    return np.minimum(n, np.minimum(lens[x], lens[y]))


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


#: Members in the order of their left contexts, the bytes that they share from the anchor, and (left, first, last): groups among them that share left bytes before it.
Groups = tuple[np.ndarray, int, list[tuple[int, int, int]]]


def repeat_groups(a: np.ndarray, before: np.ndarray, contexts: list[bytes], least: int, gram: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], Iterator[Groups]]:
    """The maximal repeat groups among contexts: groups of two as (left, depth, members) arrays, and the others.

    An interval of the common-prefix tree is a set of contexts that share depth bytes, and not all of them more. Within
    it the left contexts are sorted and scanned in the same way: members that share left bytes, and not all of them
    more, differ in the byte before (or have none). A group whose members all share more than depth is left to the deeper interval.
    """
    left = _matrix([x[:b][::-1] for x, b in zip(contexts, before.tolist(), strict=True)], least - gram)
    right = _matrix([x[b:] for x, b in zip(contexts, before.tolist(), strict=True)], least)
    after = np.fromiter(map(len, contexts), int, len(contexts)) - before
    # contexts that differ in zero bytes at their ends alone are equal as "S": the shorter one comes first
    order = np.lexsort((after, right.view(f"S{least}").ravel(), a))
    place = np.empty(len(a), int)
    place[order] = np.arange(len(a))
    rank = np.empty(len(a), int)
    rank[np.lexsort((before, left.view(f"S{least - gram}").ravel()))] = np.arange(len(a))
    lcp = np.zeros(len(a), int)
    lcp[1:] = np.where(a[order[1:]] == a[order[:-1]], _common(right, after, order[1:], order[:-1]), 0)
    tree = list(prefix_intervals(lcp.tolist(), gram))

    two = np.array([(depth, first) for depth, first, last in tree if last == first + 1], int).reshape(-1, 2)
    x, y = order[two[:, 1]], order[two[:, 1] + 1]
    shared = _common(left, before, x, y)
    ok = shared + two[:, 0] >= least

    def larger() -> Iterator[Groups]:
        for depth, first, last in tree:
            if last == first + 1:
                continue
            rows = order[first : last + 1]
            rows = rows[np.argsort(rank[rows])]
            shared = [0, *_common(left, before, rows[1:], rows[:-1]).tolist()]
            found = []
            at = place[rows].tolist()
            for deep, lo, hi in prefix_intervals(shared, max(least - depth, 1)):
                # the whole interval has it by its own depth
                if hi - lo == last - first or lcp[min(at[lo : hi + 1]) + 1 : max(at[lo : hi + 1]) + 1].min() == depth:
                    found.append((deep, lo, hi))
            if least <= depth and not min(shared[1:]):
                found.append((0, 0, last - first))  # it holds all others, so it is the last
            yield rows, depth, found

    return (shared[ok], two[ok, 0], np.stack([x[ok], y[ok]], 1)), larger()


def repeat_reach(a: np.ndarray, before: np.ndarray, contexts: list[bytes], least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and from its anchor that each context has in a repeat group."""
    (lefts, depths, pairs), larger = repeat_groups(a, before, contexts, least, gram)
    reach_l, reach_r = np.zeros(len(a), int), np.zeros(len(a), int)
    np.maximum.at(reach_l, pairs, lefts[:, None])
    np.maximum.at(reach_r, pairs, depths[:, None])
    for rows, depth, groups in larger:
        own_l, own_r = np.zeros(len(rows), int), np.zeros(len(rows), int)
        for left, lo, hi in reversed(groups):  # a group comes before those that hold it and share less
            own_l[lo : hi + 1] = left
            own_r[lo : hi + 1] = depth
        reach_l[rows] = np.maximum(reach_l[rows], own_l)
        reach_r[rows] = np.maximum(reach_r[rows], own_r)
    return reach_l, reach_r


def _by_anchor(contexts: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """work over tables of whole groups of contexts (a, c, before, ctx), each context once; groups are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            # a row of the input that repeats gives its contexts more than once, one after another
            key = np.stack([b.column("a").to_numpy(), b.column("c").to_numpy()], 1)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(1)
            new[0] = last is None or (key[0] != last).any()
            last = key[-1]
            held.append(b.filter(pa.array(new)))
            if sum(x.num_rows for x in held) >= CHUNK_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                a = t["a"].to_numpy()
                cut = int(np.searchsorted(a, a[-1]))  # the last group may go on
                if cut:
                    yield work(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return contexts.repartition("a").sortWithinPartitions("a", "c").mapInArrow(run, schema)


def _sorted_groups(contexts: DataFrame, least: int, gram: int) -> DataFrame:
    """(a, c, l, r) reaches from the repeat groups of contexts (a, c, before, ctx)."""

    def work(t: pa.Table) -> pa.RecordBatch:
        a, before = t["a"].to_numpy(), t["before"].to_numpy()
        l, r = repeat_reach(a, before, t["ctx"].to_pylist(), least, gram)
        ok = r > 0
        return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(t["c"].to_numpy()[ok]), pa.array(l[ok].astype(np.int32)), pa.array(r[ok].astype(np.int32))], ["a", "c", "l", "r"])

    return _by_anchor(contexts, work, "a long, c long, l int, r int")


def _listed_groups(contexts: DataFrame, least: int, gram: int) -> DataFrame:
    """(a, c, l, r, repeat): a row for each member of each repeat group of contexts (a, c, before, ctx)."""

    def work(t: pa.Table) -> pa.RecordBatch:
        from xxhash import xxh3_64_intdigest

        a, c, before, ctx = t["a"].to_numpy(), t["c"].to_numpy(), t["before"].to_numpy(), t["ctx"].to_pylist()
        out = [np.zeros((0, 5), np.int64)]
        (lefts, depths, pairs), larger = repeat_groups(a, before, ctx, least, gram)
        each = [*zip(lefts.tolist(), depths.tolist(), pairs, strict=True), *((left, depth, rows[lo : hi + 1]) for rows, depth, groups in larger for left, lo, hi in groups)]
        for left, depth, members in each:
            i = members[0]
            name = np.uint64(xxh3_64_intdigest(ctx[i][before[i] - left : before[i] + depth])).astype(np.int64)
            out.append(np.stack([a[members], c[members], *(np.full(len(members), x) for x in (left, depth, name))], 1))
        rows = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k].astype(np.int32 if k in (2, 3) else np.int64)) for k in range(5)], ["a", "c", "l", "r", "repeat"])

    return _by_anchor(contexts, work, "a long, c long, l int, r int, repeat long")


def _cells(contexts: DataFrame, width: int, least: int) -> DataFrame:
    """(a, c, off, key) for each cell of `width` window offsets within offs (null: all) whose core lies in the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        core = least - width + 1
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for a, c, before, ctx, wide, offs in zip(*(b.column(n).to_pylist() for n in ("a", "c", "before", "ctx", "wide", "offs")), strict=True):
                for base in [0] if offs is None else offs:
                    for off in range(base, min(before + 1, base + wide if offs is not None else before + 1), width):
                        # windows at off..off+width-1 bytes before the anchor share the core
                        s = before - off
                        if s + core <= len(ctx):
                            out.append((a, c, off, xxh3_64_intdigest(ctx[s : s + core]) - (1 << 63)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["a", "c", "off", "key"])

    return contexts.mapInArrow(run, "a long, c long, off int, key long")


def _alive_windows(contexts: DataFrame, least: int) -> DataFrame:
    """(a, c, off, key): the window offsets of contexts (a, c, before, ctx) that two contexts share, by counting cells of offsets, wide ones first."""
    alive, wide = None, 0
    for width in CELLS:
        base = contexts.withColumn("offs", F.lit(None).cast("array<int>")) if alive is None else contexts.join(alive.groupBy("a", "c").agg(F.collect_list("off").alias("offs")), ["a", "c"])
        cells = stored(_cells(base.withColumn("wide", F.lit(wide)), width, least), "cells")
        shared = cells.groupBy("a", "off", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        alive, wide = stored(cells.join(shared, ["a", "off", "key"]).select("a", "c", "off", "key"), "alive"), width
    return alive


def _counted_windows(contexts: DataFrame, least: int) -> DataFrame:
    """(a, c, l, r) reaches of contexts (a, c, before, ctx) by counting."""
    return _alive_windows(contexts, least).groupBy("a", "c").agg(F.max("off").alias("l"), (least - F.min("off")).alias("r"))


def _key() -> F.Column:
    return F.concat_ws(" ", "d", "h").alias("key")


def _told(texts: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """texts (d, h, ...) with maybe: false where a Bloom filter over the keys of rows (d, h) says that it has none of theirs."""
    bloom, blocks = bloom_filter(rows.select(_key()), rows.count())
    return probed(texts.select("*", _key()), stored(bloom, name), blocks).drop("key")


def _joined(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts (d, h, ...) with the columns of rows, null where there are none; only texts that may have some are shuffled."""
    each = _told(texts, rows, "span_filter")
    met = each.where("maybe").drop("maybe").join(rows, ["d", "h"], "left")
    rest = each.where("NOT maybe").select(*[c if c in texts.columns else F.lit(None).cast(t).alias(c) for c, t in met.dtypes])
    return met.union(rest)


def _contexts(docs: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, c, before, after) of contexts that occur twice, and (a, c, before, ctx, hot) of those whose anchor string has different ones."""
    rep = F.min(F.struct("d", "h", "pos", "before", "after")).alias("rep")
    each = stored(anchors.where("a IS NOT NULL").groupBy("a", "c").agg(F.sum("n").alias("n"), rep), "contexts")
    whole = each.where("n > 1").select("a", "c", "rep.before", "rep.after")
    # tables on both sides of a join are exchanges of their own, so adaptive execution can split a hot key
    mixed = stored(each.groupBy("a").agg(F.count("*").alias("different")).where("different > 1"), "mixed")
    wanted = each.join(mixed, "a").select("rep.*", "a", "c", (F.col("different") > GROUP).alias("hot"))
    wanted = stored(wanted.groupBy("d", "h").agg(F.collect_list(F.struct("pos", "before", "after", "a", "c", "hot")).alias("places")), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = b.column(1)
            n = np.diff(places.offsets.to_numpy())
            p = places.flatten()
            pos, before, after = (p.field(k).to_numpy() for k in ("pos", "before", "after"))
            texts = b.column(0).to_pylist()
            ctx = [texts[i][s:e] for i, s, e in zip(np.repeat(np.arange(len(n)), n).tolist(), (pos - before).tolist(), (pos + after).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([p.field("a"), p.field("c"), p.field("before"), pa.array(ctx, pa.binary()), p.field("hot")], ["a", "c", "before", "ctx", "hot"])

    texts = keyed(docs).select(F.col("_d").alias("d"), F.col("_h").alias("h"), "_text")
    texts = _told(texts, wanted, "place_filter").where("maybe").drop("maybe")
    return whole, stored(texts.join(wanted, ["d", "h"]).select("_text", "places").mapInArrow(run, "a long, c long, before int, ctx binary, hot boolean"), "context_bytes")


def reaches(docs: DataFrame, anchors: DataFrame, least: int, gram: int) -> DataFrame:
    """(a, c, l, r): how far before and from its anchor a context is covered by repeated windows."""
    whole, contexts = _contexts(docs, anchors)
    found = whole.toDF("a", "c", "l", "r").union(_sorted_groups(contexts.where("NOT hot").drop("hot"), least, gram))
    hot = contexts.where("hot").drop("hot")
    if not hot.isEmpty():
        # a row that repeats would count as two contexts of its own
        found = found.union(_counted_windows(stored(hot.dropDuplicates(["a", "c"]), "hot"), least))
    return found.groupBy("a", "c").agg(F.max("l").alias("l"), F.max("r").alias("r"))


def maximal_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(repeat, length, doc_id, start): all occurrences of each maximal repeat group, in bytes; repeat is a hash of the string.

    A repeat that is longer than the contexts of its anchors comes in pieces as long as these. Strings of anchors with
    more than GROUP different contexts come as their repeated windows of `least` bytes.
    """
    with temporary(docs.sparkSession) as keep:
        anchors = stored(anchor_table(docs, least, gram, every=True), "anchors")
        whole, contexts = _contexts(docs, anchors)
        each = whole.select("a", "c", F.col("before").alias("l"), F.col("after").alias("r"), F.xxhash64("a", "c").alias("repeat"))
        each = each.union(_listed_groups(contexts.where("NOT hot").drop("hot"), least, gram))
        hot = contexts.where("hot").drop("hot")
        if not hot.isEmpty():
            alive = _alive_windows(stored(hot.dropDuplicates(["a", "c"]), "hot"), least)
            each = each.union(alive.select("a", "c", F.col("off").alias("l"), (least - F.col("off")).alias("r"), "key"))
        places = anchors.join(stored(each, "groups"), ["a", "c"]).select("repeat", (F.col("l") + F.col("r")).alias("length"), F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), (F.col("pos") - F.col("l")).alias("start"), "h")
        return keep(places.distinct().drop("h"), "repeats")


def spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(d, h, spans) of each text with repeats: byte ranges (s, e) that cover what is repeated; they may overlap."""
    with temporary(docs.sparkSession) as keep:
        anchors = stored(anchor_table(docs, least, gram), "anchors")
        hits = anchors.join(stored(reaches(docs, anchors, least, gram), "reaches"), ["a", "c"]).select("d", "h", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("r")).alias("e"))
        local = anchors.where("a IS NULL").select("d", "h", F.col("pos").alias("s"), (F.col("pos") + F.col("after")).alias("e"))
        return keep(hits.union(local).groupBy("d", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")


def merge(ranges: list[dict]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def removals(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left; a character that a cut splits is dropped) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t, runs = t or b"", merge(x or [])
                kept = _kept(t, runs)
                rows.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    found = spans(docs, least, gram)
    texts = keyed(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", F.col("_d").alias("d"), F.col("_h").alias("h"), "_text")
    arrow_batches(docs.sparkSession, 256)
    return _joined(texts, found).select("doc_id", "_text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def cut_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes cut out of text, all columns kept; a character that a cut splits is dropped."""
    found = spans(docs, least, gram)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0)
            cols = [rows.field(i) for i in range(len(names))]
            at = names.index("text")
            texts = [t if not x else _kept(t.encode(), merge(x)).decode("utf-8", "ignore") for t, x in zip(cols[at].to_pylist(), b.column(1).to_pylist(), strict=True)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    arrow_batches(docs.sparkSession, 256)
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    rows = rows.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.col("row.text").cast("string")).alias("h"))
    return _joined(rows, found).select("row", "spans").mapInArrow(run, docs.schema)
