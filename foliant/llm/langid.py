"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, cache_of, mix, slices, tidy

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
#: Bounds of what fit() reads and keeps: rows it learns from, hash buckets, cells of the matrix (languages times buckets).
FIT_ROWS, BUCKETS, CELLS = 60_000, 1 << 16, 1 << 24
ORDERS = (1, 2, 3)
_SEEDS = mix(np.arange(1, 1 + len(ORDERS), dtype=np.uint64))
_PIECE = 1 << 21  # characters at a time


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets, float32


def grams(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hash buckets of all character n-grams of the lower-cased text, in pieces of bounded size."""
    text = text.lower()
    longest = max(ORDERS)
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer(text[at : at + _PIECE + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        here = min(_PIECE, len(text) - at)
        for n, seed in zip(ORDERS, _SEEDS, strict=True):
            k = min(here, len(c) - n + 1)
            if k > 0:
                yield _bucket(c, n, k, seed, buckets)


def _bucket(c: np.ndarray, n: int, k: int, seed: np.uint64, buckets: int) -> np.ndarray:
    h = c[:k] + seed
    for j in range(1, n):
        h = h * U64(0x100000001B3) + c[j : j + k]
    h = h * U64(0x9E3779B97F4A7C15)
    return ((h >> U64(32)) & U64(buckets - 1)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Documents that no fit may see: crc32 of the id as text leaves 2 when divided by 4. Null id: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Model:
    """Learns from labelled rows; rows with null text or language are left out.

    fit_rows bounds what is learned from: with more labelled rows, a share of them chosen by the text's hash. Any number of
    languages is learned; CELLS bounds the matrix, by fewer buckets for each where there are very many of them. Each task
    sends its non-zero counts, Spark adds them, and the matrix, whose size the bounds on languages and buckets fix, goes to
    the driver by blocks of buckets. No labelled row at all gives a model without languages.
    """
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    total = rows.count()
    if total > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())  # no more than rows that are learned from
    if not names:
        return Model([], np.zeros(0), np.zeros((0, buckets), np.float32))
    # beyond 256 languages, fewer buckets keep the matrix within its bound
    buckets = min(buckets, 1 << max(1, CELLS // len(names)).bit_length() - 1)
    block = min(buckets, 1 << 13)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("langid")
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = sums.setdefault(lang, np.zeros(buckets, np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for g in grams(text, buckets):
                    s += np.bincount(g, minlength=buckets) if len(g) > buckets // 8 else 0
                    if len(g) <= buckets // 8:
                        np.add.at(s, g, 1)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            bucket, n = np.append(at, -1).astype(np.int32), np.append(s[at], docs[lang])  # at -1 the number of texts
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(bucket), pa.array(n)], ["lang", "bucket", "n"])

    counts, docs = np.zeros((len(names), buckets)), np.zeros(len(names))
    added = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    blocks = added.groupBy("lang", F.floor(F.col("bucket") / block).alias("block")).agg(F.collect_list(F.struct("bucket", "n")).alias("c"))  # at most `block` each
    for r in blocks.toLocalIterator():
        i = names.index(r.lang)
        if r.block < 0:
            docs[i] = r.c[0].n
        else:
            counts[i, [x.bucket for x in r.c]] = [x.n for x in r.c]
    p = np.log(counts + smoothing) - np.log(counts.sum(1, keepdims=True) + smoothing * buckets)
    return Model(names, np.log(docs / docs.sum()), p.astype(np.float32))


def scores(model: Model, text: str) -> np.ndarray:
    """Log joint probability for each language, all n-grams of the whole text counted."""
    s = model.log_prior.astype(np.float64)
    for g in grams(text, model.log_prob.shape[1]):
        s = s + model.log_prob[:, g].sum(1, dtype=np.float64)
    return s


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of docs, with the predicted language and its posterior probability (0 to 1).

    Null text and text without a letter give ("und", 0.0), and so does a model without languages. Of languages that tie,
    the first by name wins. Columns of docs named as the new ones are replaced. The matrix that is broadcast has a size
    that the bounds on languages and buckets fix.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in out]
    fields = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(out[0], "string").add(out[1], "double")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, m = cache_of("langid"), shared.value
        if not kept or kept[0] is not m:
            kept[:] = [m, np.ascontiguousarray(m.log_prob.T)]
        table = kept[1]
        for batch in batches:
            for part in slices(batch, batch.schema.names[at], 4 << 20) if batch.num_rows else []:
                lang, score = _predict(m, table, part.column(at))
                kept = [part.column(i) for i in picked]
                yield pa.RecordBatch.from_arrays([*kept, lang, score], [*keep, *out])

    cols = docs.columns
    picked = [i for i, c in enumerate(cols) if c not in out]
    source = docs
    at = cols.index(text_col)
    if dict(docs.dtypes)[text_col] != "string":
        source, at = docs.withColumn("__text", F.col(f"`{text_col}`").cast("string")), len(cols)
    return source.mapInArrow(run, fields)


def _predict(m: Model, table: np.ndarray, col: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Sparse scoring of a batch: the rows of the matrix that the batch's n-grams name, summed over each text."""
    texts = col.to_pylist()
    joint = np.full((len(texts), len(m.languages)), -np.inf)
    todo = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if m.languages else []
    run: list[int] = []
    size = 0
    for i in [*todo, None]:
        if i is not None and len(texts[i]) <= 1 << 16:
            run.append(i)
            size += len(texts[i])
        if run and (i is None or size > 1 << 19):
            joint[run] = _joint(m, table, [texts[j] for j in run])
            run, size = [], 0
        if i is not None and len(texts[i]) > 1 << 16:
            joint[i] = scores(m, texts[i])
    best = joint.argmax(1) if m.languages else np.zeros(len(texts), int)
    with np.errstate(invalid="ignore", over="ignore"):
        p = 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1) if m.languages else np.zeros(len(texts))
    known = np.zeros(len(texts), bool)
    known[todo] = True
    return pa.array([m.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, p, 0.0), pa.float64())


def _joint(m: Model, table: np.ndarray, texts: list[str]) -> np.ndarray:
    """Log joint probabilities of several texts at once; their n-grams do not cross from one to the next."""
    lower = [t.lower() for t in texts]
    c = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in lower])
    ends = np.cumsum(size)
    out = np.tile(m.log_prior.astype(np.float64), (len(texts), 1))
    for n, seed in zip(ORDERS, _SEEDS, strict=True):
        k = len(c) - n + 1
        if k <= 0:
            continue
        g = table[_bucket(c, n, k, seed, table.shape[0])]
        total = np.zeros((k + 1, g.shape[1]))
        np.cumsum(g, 0, dtype=np.float64, out=total[1:])
        lo, hi = np.minimum(ends - size, k), np.clip(ends - n + 1, 0, k)
        out += total[np.maximum(lo, hi)] - total[lo]
    return out
