"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Equal vectors are one row from the start, with a count. Cell centres are fit on a sample of the distinct
vectors (those of smallest hash; SAMPLE, or FOR_EACH rows for each centre where that is more); every vector is assigned.
Their number grows with the vectors, up to CENTRES; above FLAT they are fit in two levels. A vector's home is the
cell of the nearest centre; it also visits each cell to whose bisector it stands within half of the largest
distance that two linked vectors can have. Of two linked vectors in different homes, the nearer one to the bisector of the
homes stands so near, whatever way their difference points: it visits the other's home, and no pair is missed. A
pair that meets in both homes counts in the one of smaller number.

A cell's homes and guests are packed into blocks of about BLOCK rows, one row a block, and each pair of blocks is a task of its own:
cosines in double precision, link counts per row, and a forest that connects what links connect (no more
rows than the two blocks have). So neither a hot cell nor a group of near copies gathers in a task or
becomes rows by the pair. Nothing is cut: links have a cosine of `least` or more.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing and are kept.
Vectors are compared among their own length only; a length of up to CELL_ROWS vectors is one cell. A null vec_id counts as a
vector but names no component. Repeated rows link with each other. Extra columns are ignored, and an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.llm.common import arrow_batches, components, stored, temporary

LEAST = 0.95
#: Vectors to fit centres on at least, and for each centre; most centres, and rows of a cell to aim at.
SAMPLE, FOR_EACH, CENTRES, CELL_ROWS, STEPS = 20_000, 16, 16_384, 1_500, 12
#: More centres than that are fit in two levels.
FLAT = 256
#: Rows of a block, and of the part of it that is multiplied at once.
BLOCK, TILE = 4_096, 512


def centres(x: np.ndarray, k: int) -> np.ndarray:
    """About k distinct unit centres of the unit rows of x."""
    if k <= FLAT:
        return np.unique(_k_means(x, k), axis=0)
    near = _nearest(x, _k_means(x, math.isqrt(k)))
    cells = [x[near == t] for t in np.unique(near)]
    return np.unique(np.concatenate([_k_means(rows, min(len(rows), max(1, round(k * len(rows) / len(x))))) for rows in cells]), axis=0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[s : s + 4096] @ c.T).argmax(1) for s in range(0, len(x), 4096)])


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centres by spherical k-means from spread-out rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(STEPS):
        sums = np.zeros_like(c)
        np.add.at(sums, _nearest(x, c), x)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return c


def units(column: pa.Array, dim: int) -> np.ndarray:
    return unit_rows(np.asarray(column.flatten(), np.float64).reshape(-1, dim))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(k1, k2, dim, embedding, n, least) of the distinct vectors that can link; (k1, k2) is a 128-bit hash of the vector."""
    good = usable(vectors).where("k1 IS NOT NULL")
    return good.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("dim", F.size("embedding"))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats stay floats), and the vector's hash, null if it can't link."""
    kind = dict(vectors.dtypes)["embedding"]
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>"))
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.select("vec_id", "embedding", F.when(ok, F.xxhash64("embedding")).alias("k1"), F.when(ok, F.xxhash64(F.lit(1), "embedding")).alias("k2"))


def _placed(vectors: DataFrame, fitted: dict[int, np.ndarray], margin: float) -> DataFrame:
    """(dim, cell, home, uid, n, own, visits, vector) of each vector in its home and the cells it visits.

    own is the home's number; the home's row has the visits to cells of smaller number; vector holds the components' bytes.
    """

    def place(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = x @ c.T
        home = near.argmax(1)
        some, of = np.unique(home, return_inverse=True)
        far = np.sqrt(np.maximum(2 - 2 * (c[some] @ c.T), 0))[of]
        gap = near[np.arange(len(x)), home][:, None] - near
        row, cell = np.nonzero((gap <= margin * far + 1e-12) & (np.arange(len(c))[None] != home[:, None]))
        return home, row, cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                raw = np.asarray(part.column("embedding").flatten()).reshape(-1, dim)
                n, c = len(raw), fitted.get(dim)
                home, row, cell = place(unit_rows(raw), c) if c is not None else (np.zeros(n, int), np.zeros(0, int), np.zeros(0, int))
                low = cell < home[row]
                lists = pa.ListArray.from_arrays(np.searchsorted(row[low], np.arange(n + 1)).astype(np.int32), pa.array(cell[low].astype(np.int32)))
                rows = np.concatenate([np.arange(n), row])
                bytes_ = pa.array([v.tobytes() for v in raw], pa.binary())
                visits = pa.concat_arrays([lists, pa.array([None] * len(row), lists.type)])
                cols = [np.full(len(rows), dim, np.int32), np.concatenate([home, cell]).astype(np.int32), np.arange(len(rows)) < n]
                for s in range(0, len(rows), 8192):
                    of = pa.array(rows[s : s + 8192])
                    took = [part.column("uid").take(of), part.column("n").take(of), pa.array(home.astype(np.int32)).take(of), visits[s : s + 8192], bytes_.take(of)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[s : s + 8192]) for x in cols), *took], ["dim", "cell", "home", "uid", "n", "own", "visits", "vector"])

    arrow_batches(vectors.sparkSession, 256)
    return vectors.select("dim", "uid", "n", "embedding").mapInArrow(run, "dim int, cell int, home boolean, uid long, n long, own int, visits array<int>, vector binary")


def _packed(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dim, cell, home, at, data) of each block, and (dim, cell, homes, guests): numbers of blocks, where one of them isn't 1."""
    # one row for each of the centres at most; a shuffle by cell would bring all blocks of a hot cell together
    count = lambda of: F.ceil(F.sum(of.cast("int")) / BLOCK).cast("int")
    sizes = stored(placed.groupBy("dim", "cell").agg(count(F.col("home")).alias("homes"), count(~F.col("home")).alias("guests")).where("homes <> 1 OR guests <> 0"), "sizes")
    dealt = placed.join(F.broadcast(sizes), ["dim", "cell"], "left").where("coalesce(homes, 1) > 0")
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64(F.lit(5), "uid"), F.coalesce(F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")), F.lit(1))).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        own = t.select(["uid", "n", "own", "visits", "vector"]).combine_chunks()
        with pa.ipc.new_stream(sink, own.schema) as out:
            out.write_table(own)
        first = {k: [t[k][0].as_py()] for k in ("dim", "cell", "home", "at")}
        return pa.table({**first, "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())}, schema=pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_()), ("at", pa.int32()), ("data", pa.binary())]))

    packed = dealt.select("dim", "cell", "home", "at", "uid", "n", "own", "visits", "vector").groupBy("dim", "cell", "home", "at").applyInArrow(pack, "dim int, cell int, home boolean, at int, data binary")
    return packed, sizes


def _labels(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the smallest row around that links reach; linked is over rows and cols."""
    label = np.arange(n, dtype=np.int32)
    some = (np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0)))
    linked, rows, cols = linked[np.ix_(*some)], rows[some[0]], cols[some[1]]

    def least(m: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.where(m[s : s + TILE], values[None], np.int32(n)).min(1) for s in range(0, len(m), TILE)])

    while linked.size:  # until nothing changes
        before = label.copy()
        label[rows] = np.minimum(label[rows], least(linked, label[cols]))
        label[cols] = np.minimum(label[cols], least(linked.T, label[rows]))
        label = label[label]
        if (label == before).all():
            break
    return label


def _linked(packed: DataFrame, sizes: DataFrame, dtype: np.dtype, least: float) -> DataFrame:
    """(uid, links, to): linked vectors of each row in one pair of blocks, and a vector that links reach (forest edge)."""
    b = packed.join(F.broadcast(sizes), ["dim", "cell"], "left").select("dim", "cell", "home", "at", "data", F.coalesce("homes", F.lit(1)).alias("homes"), F.coalesce("guests", F.lit(0)).alias("guests"))
    # home block i meets home blocks j >= i, and every guest block
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at, homes, guests = F.col("at"), F.col("homes"), F.col("guests")
    of_home = F.concat(F.transform(upto(homes), lambda j: pair(F.least(at, j), F.greatest(at, j))), F.transform(upto(guests), lambda j: pair(at, homes + j)))
    of_guest = F.transform(upto(homes), lambda i: pair(i, homes + at))
    met = b.withColumn("p", F.explode(F.when(F.col("home"), of_home).otherwise(of_guest))).select("dim", "cell", "home", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.when(F.col("home"), at).otherwise(homes + at).alias("block"), "data")

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        i, j, cell, dim = (t[k][0].as_py() for k in ("i", "j", "cell", "dim"))
        parts = [pa.ipc.open_stream(d.as_buffer()).read_all().combine_chunks() for d in t["data"]]
        if t.num_rows < (1 if i == j else 2):  # the hash left a block empty
            return pa.table({"uid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        xs = [unit_rows(np.frombuffer(b"".join(p["vector"].to_pylist()), dtype).reshape(-1, dim)) for p in parts]
        uids, ns = ([p[k].to_numpy() for p in parts] for k in ("uid", "n"))
        x, y = xs[0], xs[-1]
        linked = np.concatenate([x[s : s + TILE] @ y.T >= least for s in range(0, len(x), TILE)])
        if i == j:
            np.fill_diagonal(linked, False)
        elif not t["home"][1].as_py():
            # the pair has met already where a row of this cell visits the guest's home of smaller number
            own, of = np.unique(parts[1]["own"].to_numpy(), return_inverse=True)
            lists = parts[0]["visits"].combine_chunks() if isinstance(parts[0]["visits"], pa.ChunkedArray) else parts[0]["visits"]
            ends = np.asarray(lists.offsets)
            cells = np.asarray(lists.values)
            row = np.repeat(np.arange(len(x)), np.diff(ends))
            cells = cells[ends[0] : ends[-1]]
            k = np.minimum(np.searchsorted(own, cells), len(own) - 1)
            ok = (own[k] == cells) & (cells < cell)
            seen = np.zeros((len(x), len(own)), bool)
            seen[row[ok], k[ok]] = True
            linked &= ~seen[:, of]
        if i == j:
            uid, rows, cols = uids[0], np.arange(len(x)), np.arange(len(x))
            links = linked @ ns[0]
        else:
            uid, rows, cols = np.concatenate(uids), np.arange(len(x)), len(x) + np.arange(len(y))
            links = np.concatenate([linked @ ns[1], ns[0] @ linked])
        label = _labels(linked, rows, cols, len(uid))
        on = links > 0
        return pa.table({"uid": uid[on], "links": links[on].astype(np.int64), "to": uid[label[on]]})

    return met.groupBy("dim", "cell", "i", "j").applyInArrow(work, "uid long, links long, to long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, margin: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding); margin: how near to a bisector vectors visit, if not as near as no pair needs."""
    each = usable(vectors)
    if margin is None:
        margin = math.sqrt(max(2 - 2 * least, 0)) / 2
    with temporary(vectors.sparkSession) as keep:
        nodes = stored(distinct_vectors(vectors).withColumn("uid", F.monotonically_increasing_id()), "vectors")
        fitted = {}
        for dim, rows in (tuple(r) for r in nodes.groupBy("dim").count().where(F.col("count") > CELL_ROWS).collect()):  # lengths of more vectors than a cell
            k = min(rows // CELL_ROWS, CENTRES)
            sample = nodes.where(F.col("dim") == dim).orderBy("k1", "k2").limit(max(SAMPLE, FOR_EACH * k)).select("embedding").toArrow()
            fitted[dim] = centres(units(sample["embedding"].combine_chunks(), dim), k)
        packed, sizes = _packed(stored(_placed(nodes, fitted, margin), "cells"))
        dtype = np.dtype(np.float32 if dict(nodes.dtypes)["embedding"] == "array<float>" else np.float64)
        found = stored(_linked(stored(packed, "blocks"), sizes, dtype, least), "links")
        links = found.groupBy("uid").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("uid").alias("a"), F.col("to").alias("b")))
        rooted = nodes.select("k1", "k2", "uid", "n", "least").join(links, "uid", "left").join(roots, F.col("uid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "uid"))
        rooted = keep(rooted.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "least", "root"), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    of = rooted.join(named, "root").select("k1", "k2", "links", "first")
    out = each.join(of, ["k1", "k2"], "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("first")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
