"""Exact top-k by inner product with a pivot-distance index.

Every vector is keyed by its nearest pivot and the distance to it; the vectors of a cell, in order of that distance, are
cut into annuli, each packed as one row. For a query q and a vector x of an annulus [lo, hi] around pivot p the triangle
inequality gives |q - x| >= gap = max(0, |q - p| - hi, lo - |q - p|), and since 2 q.x = |q|**2 + |x|**2 - |q - x|**2, no
score in the annulus is above (|q|**2 + largest |x|**2 - gap**2) / 2. Queries, packed in blocks, first meet the annulus
with the highest bound; the k-th score found there stops the expansion at annuli whose bound is below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: The pivots are fitted on at most so many rows, those with the smallest hash of their id.
FIT_ROWS, PIVOTS = 4096, 32
ANNULUS, BLOCK = 2048, 512
#: There are never more annuli than this, so their outlines (32 bytes each) may be broadcast; beyond it annuli grow.
MOST_ANNULI = 200_000
EXACT = 2.0**53


def valid(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(col: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors, as 64-bit integers; beyond these it stops at their ends."""
    flat = np.asarray(col.flatten(), np.float64).reshape(len(col), -1)
    return np.clip(np.floor(flat * scale), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _distance(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))


def fit_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Pivots by k-means (8 rounds) from farthest-first starts; the same for the same rows."""
    x = sample.astype(np.float64)
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    p = x[chosen].copy()
    for _ in range(8):
        cell = _distance(x, p).argmin(1)
        for j in range(len(p)):
            if (cell == j).any():
                p[j] = x[cell == j].mean(0)
    return p


#: Annuli whose bounds are held at a time: with a block of queries a few MB each.
AT_A_TIME = 4_096


def _pack(ids: list, vecs: list[bytes]) -> tuple[bytes, bytes]:
    return np.array(ids, np.int64).tobytes(), b"".join(vecs)


def _matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(-1, dim)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by `every`.

    Score: inner product of floor(scale * x), in 64-bit integers. Ties go to the smaller id. Vectors that are null or hold
    null or non-finite components take no part, nor do rows with a null id; vectors of different lengths do not meet.
    Rows of one id are one vector to others: they are no candidates of that id's query, and equal rows count once. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where(F.col("id").isNotNull() & valid(F.col("v"))).withColumn("dim", F.size("v"))
    out = None
    for dim, n in sorted(map(tuple, v.where("dim > 0").groupBy("dim").count().collect())):
        got = _of_one_length(spark, v.where(F.col("dim") == dim), dim, n, k, every, scale)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _of_one_length(spark, v: DataFrame, dim: int, n: int, k: int, every: int, scale: int) -> DataFrame:
    first = v.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    pivots = fit_pivots(scaled(first.column("v").combine_chunks(), scale), PIVOTS)
    shared = spark.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = scaled(batch.column("v"), scale)
                f = x.astype(np.float64)
                d = _distance(f, shared.value)
                cell = d.argmin(1)
                blobs = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell]), pa.array((f**2).sum(1)), blobs], ["id", "cell", "dist", "norm", "x"])

    keyed = cut(v.select("id", "v").mapInArrow(key, "id long, cell int, dist double, norm double, x binary"))
    annuli = cut(_packed(keyed, max(ANNULUS, -(-n // MOST_ANNULI)), "a", dim))
    queries = cut(_packed(keyed.where(F.pmod("id", F.lit(every)) == 0), max(BLOCK, -(-n // MOST_ANNULI)), "q", dim))
    outline = annuli.select("a", "cell", "lo", "hi", "norm").toArrow()
    meta = spark.sparkContext.broadcast({c: outline.column(c).to_numpy() for c in outline.column_names})

    def bounds(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Annuli, some at a time, and for each query and annulus what no score is above. Infinite where the arithmetic is not exact."""
        for at in range(0, len(meta.value["a"]), AT_A_TIME):
            m = {c: v[at : at + AT_A_TIME] for c, v in meta.value.items()}
            yield m["a"], _bounds(x, m)

    def _bounds(x: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
        f = x.astype(np.float64)
        own = (f**2).sum(1)
        to = _distance(f, shared.value)[:, m["cell"]]
        gap = np.maximum(0, np.maximum(to - m["hi"], m["lo"] - to) - 1e-6 * (1 + to))
        b = (own[:, None] + m["norm"] - gap**2) / 2
        return np.where((own[:, None] < EXACT) & (m["norm"] < EXACT), b * (1 + 1e-9 * np.sign(b)) + 1, np.inf)

    def first_visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, ids, x in zip(*(batch.column(c).to_pylist() for c in ("q", "ids", "x")), strict=True):
                sums = ((a, b.sum(0)) for a, b in bounds(_matrix(x, dim)))
                best = max(((s.max(), -i, a[s.argmax()]) for i, (a, s) in enumerate(sums)))[2]  # the first of the highest
                yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([best]), pa.array([ids]), pa.array([x])], ["q", "a", "ids", "x"])

    def later_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, a, ids, x, least in zip(*(batch.column(c).to_pylist() for c in ("q", "a", "ids", "x", "least")), strict=True):
                stop = np.frombuffer(least, np.float64)
                at = np.concatenate([some[(b >= stop[:, None]).any(0) & (some != a)] for some, b in bounds(_matrix(x, dim))])
                for s in range(0, len(at), 16):
                    some = at[s : s + 16]
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(some)), pa.array(some), pa.array([ids] * len(some)), pa.array([x] * len(some))], ["q", "a", "ids", "x"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, a, ids, x, aids, ax in zip(*(batch.column(c).to_pylist() for c in ("q", "a", "ids", "x", "aids", "ax")), strict=True):
                yield _kernel(q, a, np.frombuffer(ids, np.int64), _matrix(x, dim), np.frombuffer(aids, np.int64), _matrix(ax, dim), k)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, a, s, i, at in zip(*(batch.column(c).to_pylist() for c in ("q", "a", "scores", "ids", "at")), strict=True):
                sc, places = np.frombuffer(s, np.int64), np.frombuffer(at, np.int64)
                stop = np.full(int(i), -np.inf)
                np.minimum.at(full := np.full(int(i), np.inf), places, sc)
                enough = np.bincount(places, minlength=int(i)) >= k
                stop[enough] = full[enough]
                yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([a]), pa.array([stop.tobytes()])], ["q", "a", "least"])

    pair, found = "q long, a long, ids binary, x binary", "q long, a long, ids long, at binary, qids binary, cands binary, scores binary"
    packed = annuli.select("a", F.col("ids").alias("aids"), F.col("x").alias("ax"))
    one = cut(queries.mapInArrow(first_visit, pair).join(packed, "a").mapInArrow(score, found))
    stops = one.mapInArrow(least, "q long, a long, least binary")
    visits = queries.select("q", "ids", "x").join(stops, "q").mapInArrow(later_visits, pair)
    two = visits.join(packed, "a").mapInArrow(score, found)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in zip(*(batch.column(c).to_pylist() for c in ("qids", "cands", "scores")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, np.int64)) for c in columns], ["query_id", "vec_id", "score"])

    all_found = one.unionByName(two).mapInArrow(rows, "query_id long, vec_id long, score long")
    best = all_found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kernel(q: int, a: int, ids: np.ndarray, x: np.ndarray, aids: np.ndarray, ax: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of one annulus for each query of one block."""
    largest = max(np.abs(x).max(initial=0), np.abs(ax).max(initial=0))
    s = (x.astype(np.float64) @ ax.T.astype(np.float64)).astype(np.int64) if float(largest) ** 2 * x.shape[1] < EXACT else x @ ax.T
    names, inverse = np.unique(aids, return_inverse=True)
    if len(names) < len(aids):  # an id with several vectors counts with its best
        best = np.full((len(names), len(ids)), np.iinfo(np.int64).min)
        np.maximum.at(best, inverse, s.T)
        s, aids = best.T, names
    at, cands, scores = [], [], []
    for i in range(len(ids)):
        row = s[i]
        own = np.flatnonzero(aids == ids[i])
        keep = np.arange(len(aids)) if not len(own) else np.flatnonzero(aids != ids[i])
        if len(keep) > k:
            edge = np.partition(row[keep], len(keep) - k)[len(keep) - k]
            keep = keep[row[keep] >= edge]
        keep = keep[np.lexsort((aids[keep], ~row[keep]))][:k]
        at.append(np.full(len(keep), i))
        cands.append(aids[keep])
        scores.append(row[keep])
    at, cands, scores = (np.concatenate(y).astype(np.int64) if y else np.empty(0, np.int64) for y in (at, cands, scores))
    return pa.RecordBatch.from_arrays([pa.array([q]), pa.array([a]), pa.array([len(ids)], pa.int64()), pa.array([at.tobytes()], pa.binary()), pa.array([ids[at].tobytes()], pa.binary()), pa.array([cands.tobytes()], pa.binary()), pa.array([scores.tobytes()], pa.binary())], ["q", "a", "ids", "at", "qids", "cands", "scores"])


def _packed(keyed: DataFrame, size: int, name: str, dim: int) -> DataFrame:
    """Annuli (of queries: blocks): one row for about `size` vectors of a cell that follow each other by distance, packed.

    Percentiles of the distance cut the cells; equal distances in great number, which no percentile parts, are dealt by a
    hash of the id.
    """
    cells = keyed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("dist", [j / 64 for j in range(1, 64)], 2000).alias("p")).collect()  # a row a pivot
    edges = {}
    for c in cells:
        want = -(-c.n // size)
        p = sorted(set(c.p))
        edges[c.cell] = [p[j * len(p) // want] for j in range(1, min(want, len(p)))]
    spark = keyed.sparkSession
    lookup = spark.sparkContext.broadcast({c: np.array(e) for c, e in edges.items()})

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dist = np.asarray(batch.column("cell")), np.asarray(batch.column("dist"))
            out = np.zeros(len(cell), np.int32)
            for c in np.unique(cell):
                out[cell == c] = np.searchsorted(lookup.value[int(c)], dist[cell == c], "right")
            yield batch.append_column("ring", pa.array(out))

    ringed = keyed.mapInArrow(ring, "id long, cell int, dist double, norm double, x binary, ring int")
    counts = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / (2 * size)).cast("int").alias("deal"))
    ringed = ringed.join(F.broadcast(counts), ["cell", "ring"])  # at most 64 rows a pivot
    ringed = ringed.withColumn("part", F.pmod(F.xxhash64("id"), "deal").cast("int"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(t.column("id")), np.asarray(t.column("dist"))))
        t = t.take(pa.array(order))
        ids, blob = _pack(t.column("id").to_pylist(), t.column("x").to_pylist())
        d, norm = np.asarray(t.column("dist")), np.asarray(t.column("norm"))
        number = (key[0].as_py() << 48) | (key[1].as_py() << 32) | key[2].as_py()
        return pa.table({name: [number], "cell": pa.array([key[0].as_py()], pa.int32()), "lo": [float(d[0])], "hi": [float(d[-1])], "norm": [float(norm.max())], "ids": [ids], "x": [blob]})

    return ringed.groupBy("cell", "ring", "part").applyInArrow(pack, f"{name} long, cell int, lo double, hi double, norm double, ids binary, x binary")
