"""Quality classifier: a sparse ensemble of rules from tree paths.

Statistics of each whole text (lengths, shares of kinds of characters, repeated words and lines) are
made over Arrow batches. Boosted trees are grown on all labelled rows; every path
from a root to a node is a conjunction of thresholds on statistics, a rule. A lasso logistic fit over
the rules' indicators gives most of them weight zero; the rest are compiled into one Spark column
expression, so that scoring needs no model on the executors.

Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2, and from all of these. Their statistics are stored in
blocks of rows; thresholds (quantiles, found by their bits), the trees' histograms and the steps of the lasso fit are sums over
the blocks, made where these are read. Only sums go to the driver: their size doesn't grow with the rows. Summands are whole numbers (gradients in
parts of UNIT), so that the fit depends neither on the order nor on the partitions of the tables. Labels, lang, source and doc_id are never inputs of a score.

Null and empty texts have all statistics zero and get a score. Rows without a label are scored too;
labels that are null are not learnt. A null doc_id is not held out and not learnt from. Rows that
repeat are scored alike; extra columns are kept, but for stats and score, which are replaced. With no labelled rows the score is 0.5; with one
class it is that class's (smoothed) share; either model has no rules.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellforge.llm.common import arrow_batches, stored, temporary, with_columns
from cellforge.llm.url_filter import bloom_filter, probed

#: Rows of a block, and tasks that sum blocks, at most.
BLOCK, TASKS = 8_192, 32
TREES, DEPTH, SHRINK, BINS, LEAST_ROWS, LASSO = 24, 3, 0.3, 48, 20, 2e-4
#: Summands are counted in parts of it, weights of rules are multiples of 1 / GRID: sums of them are exact.
UNIT, GRID = 2.0**26, 2.0**32
#: Most passes of the lasso fit, and sweeps over the weights in each; it ends where no weight's condition is missed by MISSED.
PASSES, SWEEPS, MISSED = 30, 500, 5e-7
FOLDS, HELD_OUT = 4, 2

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGIT = b"0123456789"
_SENTENCE = b".,;:?'\"-()"
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOL = bytes(b for b in range(0x21, 0x7F) if b not in _UPPER + _LOWER + _DIGIT + _SENTENCE + b"!|")
STATS = ("chars", "words", "word_len", "upper", "digits", "symbols", "exclaims", "pipes", "sentence_marks", "line_len", "same_as_last", "distinct", "line_repeats", "top_word", "wide", "end_marks")


def statistics(data: bytes) -> tuple[float, ...]:
    """STATS of a text's UTF-8 bytes."""
    n = len(data)
    if not n:
        return (0.0,) * len(STATS)
    count = lambda kinds: n - len(data.translate(None, kinds))
    words = data.split()
    m = max(len(words), 1)
    upper, lower = count(_UPPER), count(_LOWER)
    seen: dict[bytes, int] = {}
    get = seen.get
    for w in words:
        seen[w] = get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    wide = sum(len(w) for w in words if len(w) > 25)
    same = sum(map(bytes.__eq__, words[1:], words))
    return (
        math.log1p(n), math.log1p(len(words)), (n - count(_SPACE)) / m, upper / max(upper + lower, 1), count(_DIGIT) / n, count(_SYMBOL) / n, data.count(b"!") / n, data.count(b"|") / n,
        count(_SENTENCE) / n, math.log1p(n / k), same / m, len(seen) / math.sqrt(m), 1 - len(set(lines)) / k, max(seen.values(), default=0) / m, wide / n, sum(map(words_end, words)) / m,
    )


def words_end(word: bytes) -> bool:
    """Whether a word ends in a mark other than those of sentences."""
    return word[-1] < 0x80 and word[-1] in _ODD_END


_ODD_END = frozenset(_SYMBOL + b"!|")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct column stats; docs must have text."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        rows = [statistics(t or b"") for t in b.column("_bytes").to_pylist()]
        return [pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(STATS))], STATS)]

    kind = "stats struct<" + ",".join(f"{s}:double" for s in STATS) + ">"
    return with_columns(docs, [F.col("text").cast("string").cast("binary").alias("_bytes")], kind, make)


#: One side of a rule: (statistic, whether it must be above the threshold, threshold).
Part = tuple[int, bool, float]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[float, tuple[Part, ...]], ...]  # (weight, parts)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for w, parts in self.rules:
            z += w * _holds(x, parts)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str = "stats") -> Column:
        """The score as a Spark column over a statistics struct."""
        z = F.lit(self.intercept)
        for w, parts in self.rules:
            cond = F.lit(True)
            for s, above, t in parts:
                c = F.col(f"{stats}.{STATS[s]}")
                cond = cond & ((c > t) if above else (c <= t))
            z = z + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _holds(x: np.ndarray, parts: tuple[Part, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, above, t in parts:
        out &= (x[:, s] > t) if above else (x[:, s] <= t)
    return out


#: What a function of a block of rows (x, y) gives, one array, summed over all blocks.
Totals = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _totals(blocks: DataFrame, kind: type) -> Totals:
    """Sums over a table of blocks (x, y), of a task's blocks in the task."""

    def totals(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    part = f(np.frombuffer(x, kind).reshape(len(y), -1), np.frombuffer(y, np.uint8))
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        arrow_batches(blocks.sparkSession, 4)
        return sum(np.frombuffer(r[0]) for r in blocks.coalesce(TASKS).mapInArrow(run, "sums binary").collect())

    return totals


def _keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 32 bits in the order of x, which is rounded up to single precision."""
    f = x.astype(np.float32)
    bits = (np.where(f < x, np.nextafter(f, np.float32(np.inf)), f) + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)


def _of_keys(k: np.ndarray) -> np.ndarray:
    k = k.astype(np.uint32)
    return np.where(k >> 31, k & np.uint32((1 << 31) - 1), ~k).view(np.float32).astype(float)


def _cuts(totals: Totals, n: int, width: int) -> list[np.ndarray]:
    """The thresholds of each statistic: quantiles of all n rows, found from their leading bits on, eight a pass."""
    at = np.linspace(0, 1, BINS + 1)[1:-1] * (n - 1)
    ranks = np.unique(np.concatenate([np.floor(at), np.ceil(at)])).astype(np.int64)
    heads, left = np.zeros((width, len(ranks)), np.uint64), np.tile(ranks, (width, 1))
    for shift in (24, 16, 8, 0):
        known = [np.unique(h) for h in heads]
        slots = max(map(len, known))

        def count(x: np.ndarray, y: np.ndarray, known: list[np.ndarray] = known, slots: int = slots, shift: int = shift) -> np.ndarray:
            out = []
            for s in range(x.shape[1]):
                k = _keys(x[:, s]) >> np.uint64(shift)
                i = np.minimum(np.searchsorted(known[s], k >> np.uint64(8)), len(known[s]) - 1)
                ok = known[s][i] == k >> np.uint64(8)
                out.append(np.bincount(i[ok] * 256 + (k[ok] & np.uint64(255)).astype(np.int64), minlength=slots * 256))
            return np.concatenate(out).astype(float)

        found = totals(count).reshape(width, slots, 256)
        for s in range(width):
            upto = np.cumsum(found[s][np.searchsorted(known[s], heads[s])], axis=1).astype(np.int64)
            digit = (upto <= left[s][:, None]).sum(1)
            left[s] -= np.where(digit > 0, upto[np.arange(len(ranks)), digit - 1], 0)
            heads[s] = heads[s] << np.uint64(8) | digit.astype(np.uint64)
    low, high, part = np.searchsorted(ranks, np.floor(at)), np.searchsorted(ranks, np.ceil(at)), at - np.floor(at)
    return [np.unique(v[low] + (v[high] - v[low]) * part) for v in map(_of_keys, heads)]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bins of x: x <= cuts[b] if and only if its bin <= b."""
    return np.stack([np.searchsorted(c, x[:, s], side="left") for s, c in enumerate(cuts)], 1).astype(np.uint8)


#: A path's parts with the number of the threshold instead of the threshold.
Bins = tuple[tuple[int, bool, int], ...]


def _grown(totals: Totals, cuts: list[np.ndarray], prior: float) -> list[Bins]:
    """Paths of boosted trees: each tree fits the logistic loss's gradient over binned statistics. A level of a tree is a pass."""
    width, n, found = len(cuts), 0, {}
    leaves: list[tuple[float, Bins]] = []
    for _ in range(TREES):
        level: list[Bins] = [()]
        grown: list[tuple[float, Bins]] = []
        for depth in range(1, DEPTH + 1):

            def histograms(x: np.ndarray, y: np.ndarray, leaves: list = leaves, level: list = level) -> np.ndarray:
                z = np.full(len(y), prior)
                for value, parts in leaves:
                    z[_holds(x, parts)] += value
                p = 1 / (1 + np.exp(-z))
                g, h = np.round((y - p) * UNIT), np.round((p * (1 - p) + 1e-6) * UNIT)
                out = []
                for parts in level:
                    on = np.flatnonzero(_holds(x, parts))
                    out += [np.bincount(x[on, s], w, BINS) for w in (g[on], h[on], np.ones(len(on))) for s in range(width)]
                return np.concatenate(out)

            sums, following = totals(histograms).reshape(len(level), 3, width, BINS), []
            n = n or sums[0, 2, 0].sum()
            for parts, (gs, hs, ns) in zip(level, sums, strict=True):
                gs, hs = gs / UNIT, hs / UNIT
                G, H, rows = gs[0].sum(), hs[0].sum(), ns[0].sum()
                best = (1e-4 * n**0.5, None, None)
                for s, c in enumerate(cuts if rows >= 2 * LEAST_ROWS else []):
                    if not len(c):
                        continue
                    gl, hl, nl = (np.cumsum(v[s][: len(c)]) for v in (gs, hs, ns))
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    gain[(nl < LEAST_ROWS) | (rows - nl < LEAST_ROWS)] = -1
                    if gain[k := int(gain.argmax())] > best[0]:
                        best = (gain[k], s, k)
                if best[1] is None:
                    grown.append((SHRINK * G / (H + 1), parts))
                    continue
                _, s, k = best
                a, b = gs[s][: k + 1].sum(), hs[s][: k + 1].sum()
                for above, g, h in ((False, a, b), (True, G - a, H - b)):
                    path = (*parts, (s, above, k))
                    found.setdefault(frozenset(path), path)
                    if depth == DEPTH:
                        grown.append((SHRINK * g / (h + 1), path))
                    else:
                        following.append(path)
            level = following
            if not level:
                break
        leaves = leaves + grown
    return list(found.values())


def _named(path: Bins, cuts: list[np.ndarray]) -> tuple[Part, ...]:
    return tuple((s, above, float(cuts[s][k])) for s, above, k in path)


def _prior(mean: float) -> float:
    return math.log((mean + 1e-3) / (1 - mean + 1e-3))


def _paths(x: np.ndarray, y: np.ndarray) -> list[tuple[Part, ...]]:
    """The paths of trees grown on rows that are at hand."""
    cuts = _cuts(lambda f: f(x, y), len(y), x.shape[1])
    bins = _binned(x, cuts)
    return [_named(p, cuts) for p in _grown(lambda f: f(bins, y), cuts, _prior(y.mean()))]


def _step(w: np.ndarray, grad: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The weights (the intercept first) where the loss's quadratic form at w and the penalty are least, by coordinates."""
    v, q, d = w.copy(), grad.copy(), np.diag(gram)
    on = np.flatnonzero(d > 1e-12).tolist()
    for _ in range(SWEEPS):
        most = 0.0
        for j in on:
            u = v[j] - q[j] / d[j]
            if j:
                u = math.copysign(max(abs(u) - LASSO / d[j], 0), u)
            if u != v[j]:
                q += gram[j] * (u - v[j])
                most = max(most, abs(u - v[j]) * d[j])
                v[j] = u
        if most < MISSED / 50:
            break
    return v


def _weights(totals: Totals, m: int, n: int, prior: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic fit of m rules with an L1 penalty on the weights, by proximal Newton steps. x of the totals are the rules' indicators."""
    w = best = np.concatenate([[np.round(prior * GRID) / GRID], np.zeros(m)])
    least = math.inf
    for _ in range(PASSES):

        def sums(r: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            r = np.concatenate([np.ones((len(y), 1)), r], 1)
            z = r @ w
            p = 1 / (1 + np.exp(-z))
            whole = lambda v: np.round(v * UNIT)
            return np.concatenate([[whole(np.logaddexp(0, z) - y * z).sum()], r.T @ whole(p - y), ((r.T * whole(p * (1 - p))) @ r).ravel()])

        got = totals(sums) / UNIT / n
        loss, grad, gram = got[0] + LASSO * np.abs(w[1:]).sum(), got[1 : m + 2], got[m + 2 :].reshape(m + 1, m + 1)
        if loss > least + 1e-8:  # the step went too far
            w = np.round((w + best) / 2 * GRID) / GRID
            continue
        least, best = loss, w
        missed = np.where(w != 0, np.abs(grad + LASSO * np.sign(w)), np.maximum(np.abs(grad) - LASSO, 0))
        missed[0] = abs(grad[0])
        if missed.max() < MISSED:
            break
        w = np.round(_step(w, grad, gram) * GRID) / GRID
    return float(best[0]), best[1:]


def _lasso(r: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The fit on indicators that are at hand."""
    return _weights(lambda f: f(r, y), r.shape[1], len(y), _prior(y.mean()))


def _one_class(n: int, ones: int) -> Model:
    p = (ones + 1) / (n + 2)
    return Model(math.log(p / (1 - p)), ())


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(x, y): statistics (doubles, a row after the other) and labels (bytes) of rows (quality, stats), so many a block; fewer at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            x = np.concatenate([np.stack([p.column(1).field(i).to_numpy(zero_copy_only=False) for i in range(len(STATS))], 1) for p in parts])
            y = np.concatenate([p.column(0).to_numpy(zero_copy_only=False) for p in parts]).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y)], ["x", "y"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(p.num_rows for p in held) >= block:
                yield packed(held)
                held = []
        if sum(p.num_rows for p in held):
            yield packed(held)

    return rows.select("quality", "stats").mapInArrow(run, "x binary, y binary")


def fit(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> Model:
    """Fits labels.quality on all labelled rows that are not held out; block decides the cost alone.

    A doc_id that has several texts or labels is fit with each of them.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where((fold() != HELD_OUT) & F.col("quality").isin(0, 1))
    key = F.col("doc_id").cast("string").alias("key")
    with temporary(docs.sparkSession):
        known = stored(known, "known")
        # statistics of texts that the filter lets pass are made in place, and joined instead of the texts
        bloom, blocks = bloom_filter(known.select(key), known.count())
        near = probed(docs.select("doc_id", "text", key), stored(bloom, "filter"), blocks).where("maybe").select("doc_id", "text")
        each = stored(with_statistics(near).select("doc_id", "stats").join(known, "doc_id").select("quality", "stats"), "statistics")
        arrow_batches(docs.sparkSession, block)
        rows = stored(_blocks(each, block), "rows")
        totals = _totals(rows, np.float64)
        n, ones = map(int, np.zeros(2) + totals(lambda x, y: np.array([len(y), y.sum()], float)))
        if not n:
            return Model(0.0, ())
        if ones in (0, n):
            return _one_class(n, ones)
        cuts, prior = _cuts(totals, n, len(STATS)), _prior(ones / n)
        bins = stored(_binned_blocks(rows, cuts), "bins")
        totals = _totals(bins, np.uint8)
        paths = _grown(totals, cuts, prior)
        of_rules = lambda f: totals(lambda x, y: f(np.stack([_holds(x, p) for p in paths], 1).astype(float) if paths else np.zeros((len(y), 0)), y))
        b, w = _weights(of_rules, len(paths), n, prior)
    return Model(b, tuple((float(a), _named(p, cuts)) for a, p in zip(w, paths, strict=True) if abs(a) > 1e-9))


def _binned_blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Blocks with bins instead of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [_binned(np.frombuffer(v, np.float64).reshape(-1, len(cuts)), cuts).tobytes() for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], ["x", "y"])

    arrow_batches(rows.sparkSession, 4)
    return rows.coalesce(TASKS).mapInArrow(run, "x binary, y binary")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1)."""
    return with_statistics(docs.drop("score")).withColumn("score", model.column()).drop("stats")
