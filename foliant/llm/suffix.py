"""Exact removal of repeated byte strings over a whole corpus, by prefix-free parsing.

A rolling hash over TRIGGER bytes marks triggers; they cut each text into phrases that overlap by a trigger. A string of
`length` bytes that holds a trigger starts in a suffix of one phrase, of `a` bytes before its first trigger, and goes on
along the parse; equal strings have equal phrase suffixes and equal continuations of the parse. So the corpus order of
strings is that of (phrase suffix, parse from the next trigger), and only its classes of equal strings matter here:
they are found by hashes of the two, in shares of the order that any number of tasks can take, instead of one suffix
array in one memory. Strings without a trigger lie within one long phrase of the dictionary and are taken one by one.

Most of a corpus is not repeated, so classes are narrowed in passes over the text, each of which leaves a bitmap of
bounded size of what is still to be told apart:
    1. contexts of triggers (the parse after the trigger, or for long phrase suffixes the part before it) that occur twice;
    2. blocks of 64 string starts before such a trigger: the bytes that all its strings share (core) occur twice, and
       whether all occurrences of the core continue alike to both ends (then the block is one unit) or differ (mixed);
    3. the same in mixed blocks for blocks of 8 starts; mixed ones fall into single strings.
Units then meet by 128-bit hashes in a sort that settles exactly which occur twice. False hits of a bitmap cost time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Bitmap, Rolling, bitmap, cut, mix, parts, raw, runs, slices

TRIGGER, DENSITY = 16, 64
COARSE, FINE = 64, 8

_A, _B = Rolling(3), Rolling(4)


class Parse:
    """The triggers of a batch of texts and what hangs on them; `off` has the texts' ends."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int):
        self.off, self.length = off, length
        self.prefix = _A.prefix(data)
        self.data = data
        hits = np.flatnonzero(_A.every(self.prefix, TRIGGER) % U64(DENSITY) == 0)
        text = np.searchsorted(off, hits, "right") - 1
        inside = hits + TRIGGER <= off[text + 1]
        self.at, self.text = hits[inside], text[inside]
        first = np.ones(len(self.at), bool)
        first[1:] = self.text[1:] != self.text[:-1]
        prev = np.empty(len(self.at), np.int64)
        prev[1:] = self.at[:-1]
        prev[first] = off[self.text[first]] - 1
        # strings whose first trigger this is start a bytes before it, low <= a <= high
        self.high = np.minimum(self.at - prev - 1, length - TRIGGER)
        self.low = np.maximum(0, self.at + length - off[self.text + 1])
        self.middle = (length - TRIGGER) // 2 // COARSE * COARSE  # from here on the context lies before the trigger

    def of(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return mix(_A.of(self.prefix, start, end) + U64(salt))

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(trigger number, key) of contexts after triggers and of those before."""
        right = np.flatnonzero(self.low < np.minimum(self.high + 1, self.middle))
        t = self.at[right]
        left = np.flatnonzero((self.high >= self.middle) & (self.low <= self.high))
        u = self.at[left]
        return right, self.of(t, t + self.length - self.middle + 1, 1), left, self.of(u - self.middle, u + TRIGGER, 2)

    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of strings without a trigger, and their keys."""
        n = len(self.off) - 1
        begin, text = np.concatenate([self.at + 1, self.off[:-1]]), np.concatenate([self.text, np.arange(n)])
        # between one trigger (or the text's start) and the next (or its end)
        k = np.lexsort((begin, text))
        begin, text = begin[k], text[k]
        last = np.ones(len(begin), bool)
        last[:-1] = text[1:] != text[:-1]
        stop = np.empty(len(begin), np.int64)
        stop[:-1] = begin[1:] - 1 + TRIGGER - 1  # the next trigger may begin but not end inside
        stop[last] = self.off[text[last] + 1]
        count = np.maximum(0, stop - self.length - begin + 1)
        s = runs(begin, count)
        return s, self.of(s, s + self.length, 3)

    def surviving(self, known: Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Triggers with a context that occurs twice, as (number, least a, largest a)."""
        right, rk, left, lk = self.contexts()
        r, s = right[known.has(rk)], left[known.has(lk)]
        return np.concatenate([r, s]), np.concatenate([self.low[r], np.maximum(self.low[s], self.middle)]), np.concatenate([np.minimum(self.high[r], self.middle - 1), self.high[s]])

    def blocks(self, number: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Blocks of `size` values of a: (trigger number, least a, largest a, key of the core, key of the whole)."""
        first = low // size
        count = np.maximum(0, high // size - first + 1)
        i = np.repeat(np.arange(len(number)), count)
        j = runs(first, count)
        a, b, t = np.maximum(j * size, low[i]), np.minimum(j * size + size - 1, high[i]), self.at[number[i]]
        core = self.of(t - j * size, t - (j * size + size - 1) + self.length, 16 + size)
        core = mix(core + (j.astype(np.uint64) << U64(16)))
        whole = self.of(t - b, t - a + self.length, 17 + size)
        return number[i], a, b, core, mix(whole + (a.astype(np.uint64) << U64(32)) + b.astype(np.uint64))


def _twice(base: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20) if batch.num_rows else []:
                data, off, _ = raw(part.column("text"))
                p = Parse(data, off, length)
                k, n = np.unique(np.concatenate([p.contexts()[1], p.contexts()[3], p.bare()[1]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return base.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _cores(base: DataFrame, length: int, find) -> tuple[Bitmap, Bitmap]:
    """Bitmaps of the cores that occur twice and of those that go on differently; find(parse) gives (core, whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20) if batch.num_rows else []:
                data, off, _ = raw(part.column("text"))
                core, whole = find(Parse(data, off, length))
                if not len(core):
                    continue
                order = np.lexsort((whole, core))
                core, whole = core[order], whole[order]
                edge = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
                end = np.append(edge[1:], len(core))
                yield pa.RecordBatch.from_arrays([pa.array(core[edge].view(np.int64)), pa.array(end - edge, pa.int64()), pa.array(whole[edge].view(np.int64)), pa.array(whole[end - 1].view(np.int64))], ["key", "n", "lo", "hi"])

    found = base.select("text").mapInArrow(run, "key long, n long, lo long, hi long").groupBy("key")
    found = cut(found.agg(F.sum("n").alias("n"), F.min(F.least("lo", "hi")).alias("lo"), F.max(F.greatest("lo", "hi")).alias("hi")).where("n > 1"))
    return bitmap(found), bitmap(found.where("lo <> hi"))


UNIT = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "<i4"), ("sure", "<i4")])

SPAN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by document and place; those that touch or overlap become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    lift = np.cumsum(first) * (1 << 42)  # a text is shorter than this, so no maximum passes to the next
    reach = np.maximum.accumulate(end + lift) - lift
    new = first.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def repeated(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, spans (of removed bytes, maximal), kept (the other bytes).

    A byte goes if a string of `length` bytes (at least 80) that covers it also starts anywhere else, in the same text or
    another; strings are judged on the input. Texts are UTF-8 bytes; null counts as empty; matches do not cross texts.
    A row that is repeated is another text, so all strings of both go. Other columns are ignored; an empty table gives no rows.
    """
    if length < 80:
        raise ValueError("length is below 80")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("key", F.xxhash64("doc_id", "text"))
    share = spark.sparkContext.broadcast
    known = share(bitmap(_twice(base, length)))

    def coarse(p: Parse) -> tuple[np.ndarray, np.ndarray]:
        return p.blocks(*p.surviving(known.value), COARSE)[3:]

    twice, mixed = map(share, _cores(base, length, coarse))

    def fine(p: Parse) -> tuple[np.ndarray, np.ndarray]:
        number, a, b, core, _ = p.blocks(*p.surviving(known.value), COARSE)
        m = mixed.value.has(core)
        return p.blocks(number[m], a[m], b[m], FINE)[3:]

    twice8, mixed8 = map(share, _cores(base, length, fine))
    n = parts(spark)

    def units(p: Parse) -> tuple[np.ndarray, np.ndarray]:
        """(start of the first string, number of strings) of all units."""
        number, a, b, core, _ = p.blocks(*p.surviving(known.value), COARSE)
        m = mixed.value.has(core)
        one = twice.value.has(core) & ~m
        f = p.blocks(number[m], a[m], b[m], FINE)
        g = mixed8.value.has(f[3])
        eight = twice8.value.has(f[3]) & ~g
        s, k = p.bare()
        s = s[known.value.has(k)]
        single = runs(p.at[f[0][g]] - f[2][g], (f[2] - f[1] + 1)[g])
        starts = [p.at[number[one]] - b[one], p.at[f[0][eight]] - f[2][eight], single, s]
        counts = [(b - a + 1)[one], (f[2] - f[1] + 1)[eight], np.ones(len(single), np.int64), np.ones(len(s), np.int64)]
        return np.concatenate(starts), np.concatenate(counts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20) if batch.num_rows else []:
                data, off, _ = raw(part.column("text"))
                p = Parse(data, off, length)
                s, k = units(p)
                if not len(s):
                    continue
                u = np.zeros(len(s), UNIT)
                end = s + k - 1 + length
                u["h1"], u["h2"] = p.of(s, end, 99), _B.of(_B.prefix(data), s, end)
                text = np.searchsorted(off, s, "right") - 1
                u["doc"], u["start"], u["n"] = np.asarray(part.column("key"))[text], s - off[text], k
                # what occurs twice here is settled here; one of each goes on to meet those elsewhere
                u = u[np.lexsort((u["h2"], u["h1"]))]
                same = (u["h1"][1:] == u["h1"][:-1]) & (u["h2"][1:] == u["h2"][:-1])
                u["sure"][1:] |= same
                u["sure"][:-1] |= same
                head = np.concatenate([[True], ~same])
                to = (u["h1"] % U64(n)).astype(np.int64)
                rest = u[~head]
                rest["h1"] = rest["h2"] = 0
                to = np.concatenate([to[head], (rest["doc"].view(np.uint64) % U64(n)).astype(np.int64)])
                u = np.concatenate([u[head], rest])
                order = np.argsort(to, kind="stable")
                edge = np.searchsorted(to[order], np.arange(n + 1))
                full = np.flatnonzero(np.diff(edge))
                u = u[order]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([u[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary())], ["to", "units"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("units").to_pylist()]
        if not blobs:
            return
        u = np.frombuffer(b"".join(blobs), UNIT)
        order = np.lexsort((u["h2"], u["h1"]))
        h1, h2 = u["h1"][order], u["h2"][order]
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        yes = u["sure"][order] > 0
        yes[1:] |= same
        yes[:-1] |= same
        u = u[order[yes]]
        doc, start, end = _joined(u["doc"], u["start"], u["start"] + u["n"] - 1 + length)
        spans = np.empty(len(doc), SPAN)
        spans["doc"], spans["start"], spans["end"] = doc, start, end
        to = (doc.view(np.uint64) % U64(n)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[order], np.arange(n + 1))
        full = np.flatnonzero(np.diff(edge))
        spans = spans[order]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([spans[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary())], ["to", "spans"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("spans").to_pylist()]
        if not blobs:
            return
        x = np.frombuffer(b"".join(blobs), SPAN)
        doc, start, end = _joined(x["doc"], x["start"], x["end"])
        pairs = np.stack([start, end], 1).astype("<i8")
        edge = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc))
        for k in range(0, len(edge) - 1, 10_000):
            e = edge[k : k + 10_001]
            yield pa.RecordBatch.from_arrays([pa.array(doc[e[:-1]]), pa.array([pairs[i:j].tobytes() for i, j in zip(e[:-1], e[1:], strict=True)], pa.binary())], ["doc", "found"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text", 8 << 20) if batch.num_rows else []:
                data, off, _ = raw(part.column("text"))
                whole = data.tobytes()
                out: tuple[list, list, list] = ([], [], [])
                for a, b, found in zip(off[:-1].tolist(), off[1:].tolist(), part.column("found").to_pylist(), strict=True):
                    merged = np.frombuffer(found or b"", "<i8").reshape(-1, 2).tolist()
                    at, kept = a, []
                    for x, y in merged:
                        kept.append(whole[at : a + x])
                        at = a + y
                    kept.append(whole[at:b])
                    out[0].append(sum(y - x for x, y in merged))
                    out[1].append([{"start": x, "end": y} for x, y in merged])
                    out[2].append(b"".join(kept))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], span), pa.array(out[2], pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    sent = base.select("key", "text").mapInArrow(emit, "to int, units binary").repartitionById(n, F.col("to"))
    settled = sent.mapInArrow(settle, "to int, spans binary").repartitionById(n, F.col("to"))
    spans = settled.mapInArrow(gather, "doc long, found binary")
    kind = docs.schema[id_col].dataType.simpleString()
    joined = base.join(spans, base["key"] == spans["doc"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(keep, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
