"""Benchmark decontamination: Wu-Manber search for the benchmark's word windows in every document.

Texts are normalised to lower-case words with one space before, between and after them, so that a window is the byte
string " w1 w2 ... wk ". Patterns are dealt into a few length classes, so that one short item does not shorten the
shifts of the long ones. Within a class all patterns are searched by their first m bytes, m being the least length:
a table over hashes of blocks (12 bytes, fewer where m is small) tells how far the search may move, at shift 0 a
bucket by the hash of those m bytes' suffix names the patterns, and a direct comparison of all bytes confirms.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, cache_of, cut, raw, runs, slices, tidy

WINDOW = 13
#: Windows that are searched at a time (about 2 MB of text; measured: 173 MB and 5 s to build the tables); beyond it there are several passes.
MOST_WINDOWS = 300_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[np.r_[0:48, 58:65, 91:97, 123:128]] = 32  # after lower-casing, what is no digit, letter or non-ASCII byte
_TO = _LOWER.tobytes()


def normal(text: bytes) -> bytes:
    """" w1 w2 ... wn ", or b"" without a word."""
    w = text.translate(_TO).split()
    return b" " + b" ".join(w) + b" " if w else b""


def pieces(text: bytes, size: int, most: int) -> Iterator[tuple[bytes, int]]:
    """Normal parts of a text that hold each of its windows once, at most `most` in a part, with their number."""
    w = normal(text).split()
    for k in range(0, max(1, len(w) - size + 1) if w else 0, most):
        part = w[k : k + most + size - 1]
        yield b" " + b" ".join(part) + b" ", max(1, len(part) - size + 1)


def windows(parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the joined parts: each window's first and end byte, and its part."""
    joined = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    blanks = np.flatnonzero(joined == 32)
    first = np.searchsorted(blanks, ends - [len(p) for p in parts])
    words = np.searchsorted(blanks, ends) - first - 1
    count = np.maximum(1, words - size + 1)
    part = np.repeat(np.arange(len(parts)), count)
    k = runs(first, count)
    return blanks[k], blanks[k + np.minimum(size, words)[part]] + 1, part


def _block_size(m: int) -> int:
    """Bytes of a block: enough that a block of other text is seldom one of the patterns', yet leaving long shifts."""
    return max(b for b in (1, 2, 4, 8, 12) if b == 1 or 2 * b <= m or (b <= 4 and b <= m))


class Searcher:
    """Wu-Manber tables for patterns of one length class, places in one byte array; finds in all texts of a batch at once."""

    def __init__(self, held: bytes, start: np.ndarray, end: np.ndarray):
        self.held, self.start, self.lengths = held, start, end - start
        self.m = m = int(self.lengths.min())
        self.b = b = _block_size(m)
        self.bits = min(24, max(12, (4 * len(start) * (m - b + 1)).bit_length()))
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        flat = _loadable(np.frombuffer(held, np.uint8))
        for j in range(b, m + 1):  # the block that ends at j
            np.minimum.at(self.shift, self.block(flat, start + j), m - j)
        tails = self.tail(flat, start + m)
        order = np.argsort(tails, kind="stable")
        self.tails, self.by_tail = tails[order], order

    def block(self, flat: dict[int, np.ndarray], end: np.ndarray) -> np.ndarray:
        """Table places of the blocks that end at these places."""
        if self.b <= 8:
            h = flat[self.b][end - self.b].astype(np.uint64)
        else:
            h = flat[8][end - 8] * np.uint64(0x9E3779B97F4A7C15) ^ flat[4][end - 12].astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def tail(self, flat: dict[int, np.ndarray], end: np.ndarray) -> np.ndarray:
        """Hashes of the last bytes of the heads, 24 of them if there are so many."""
        out = np.zeros(len(end), np.uint64)
        left = min(self.m, 24)
        for width in (8, 8, 8, 4, 2, 1):
            while left >= width and (width < 8 or left >= 8):
                out = (out ^ flat[width][end - left].astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
                out ^= out >> np.uint64(31)
                left -= width
        return out

    def find(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, place) of all occurrences in text[start[i]:end[i]], for all i; the cursors of all texts step together."""
        m, raw_bytes = self.m, text.tobytes()
        flat = _loadable(text)
        found: tuple[list[int], list[int]] = ([], [])
        # long texts are searched by several cursors, each of which owns the places where an occurrence may start
        piece = 1 << 12
        count = np.maximum(1, -(-(end - start) // piece))
        who = np.repeat(np.arange(len(start)), count)
        nth = runs(np.zeros(len(start), np.int64), count)
        at = start[who] + nth * piece + m  # one past the last byte of the head under test
        stop = np.minimum(end[who], start[who] + (nth + 1) * piece + m - 1)
        limit = end[who]
        live = at <= stop
        at, stop, limit = at[live], stop[live], limit[live]
        while len(at):
            s = self.shift[self.block(flat, at)]
            zero = np.flatnonzero(s == 0)
            if len(zero):
                z, ends = at[zero], limit[zero]
                t = self.tail(flat, z)
                lo, hi = np.searchsorted(self.tails, t), np.searchsorted(self.tails, t, "right")
                for i in np.flatnonzero(hi > lo):
                    place = int(z[i]) - m
                    for p in self.by_tail[lo[i] : hi[i]]:
                        size, begin = self.lengths[p], self.start[p]
                        if place + size <= ends[i] and raw_bytes[place : place + size] == self.held[begin : begin + size]:
                            found[0].append(int(p))
                            found[1].append(place)
            at = at + np.maximum(s, 1)
            live = at <= stop
            if not live.all():
                at, stop, limit = at[live], stop[live], limit[live]
        return np.array(found[0], np.int64), np.array(found[1], np.int64)


def _loadable(text: np.ndarray) -> dict[int, np.ndarray]:
    """Views that give the 1, 2, 4 or 8 bytes at any place as one number."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return {w: np.ndarray((len(padded) - w + 1,), f"<u{w}", padded, 0, (1,)) for w in (1, 2, 4, 8)}


_A, _B = Rolling(11), Rolling(12)


class Benchmark:
    """All windows of all items, by length class, and the items of each. Equal windows (128 bits of hash) are one pattern."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        """items: ids and normal texts."""
        held = b"".join(t for _, t in items)
        self.searchers: list[Searcher] = []
        self.owners: list[tuple[np.ndarray, np.ndarray]] = []
        self.names = [i for i, _ in items]
        if not held:
            return
        start, end, part = windows([t for _, t in items], size)
        data = np.frombuffer(held, np.uint8)
        one, two = (h.of(h.prefix(data), start, end) for h in (_A, _B))
        kind = np.array([max(0, min(5, int(n).bit_length() - 3)) for n in range(int((end - start).max()) + 1)])[end - start]
        for k in np.unique(kind).tolist():
            mine = np.flatnonzero(kind == k)
            mine = mine[np.lexsort((two[mine], one[mine]))]
            new = np.concatenate([[True], (one[mine][1:] != one[mine][:-1]) | (two[mine][1:] != two[mine][:-1])])
            self.searchers.append(Searcher(held, start[mine[new]], end[mine[new]]))
            self.owners.append((np.append(np.flatnonzero(new), len(mine)), part[mine]))

    def hits(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """For each normalised text: number of words, hit words as runs (first, one past), items."""
        joined = b"".join(texts)
        text = np.frombuffer(joined, np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        end = np.cumsum(size)
        start = end - size
        n_words = [max(0, t.count(b" ") - 1) for t in texts]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for s, (edge, owner) in zip(self.searchers, self.owners, strict=True):
            p, place = s.find(text, start, end)
            for i, a, b, q in zip(np.searchsorted(end, place, "right"), place, place + s.lengths[p] if len(p) else place, p, strict=True):
                spans[i].append((int(a - start[i]), int(b - start[i])))
                items[i].update(self.names[o] for o in owner[edge[q] : edge[q + 1]])
        out = []
        for t, found in zip(texts, spans, strict=True):
            merged: list[tuple[int, int]] = []
            if found:
                blanks = np.flatnonzero(np.frombuffer(t, np.uint8) == 32)
                found = sorted(set(found))
                a, b = np.searchsorted(blanks, [x[0] for x in found]), np.searchsorted(blanks, [x[1] - 1 for x in found])
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    if merged and x <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
                    else:
                        merged.append((x, y))
            out.append(merged)
        return n_words, out, items


SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,end:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, items (ids as strings, sorted as strings), spans of hit words, contaminated.

    Null text, of a document or an item, has no words; an item without words never occurs; an item with a null id is left out.
    Items that repeat count once. contaminated: n_hit > 0 and 20 * n_hit >= n_words. Other columns are ignored, rows
    are kept one for one. The benchmark is searched in passes of at most MOST_WINDOWS windows, which bounds what is broadcast
    and each worker's tables; long items are cut into parts that overlap, and a pass's result is held before the next.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    most = max(1, MOST_WINDOWS // 16)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (part, n) in enumerate(pieces(t.encode(), window, most)):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([k], pa.int64()), pa.array([part], pa.binary()), pa.array([n], pa.int64())], ["i", "k", "t", "n"])

    parts = cut(items.mapInArrow(split, "i string, k long, t binary, n long"))
    passes = -(-(parts.agg(F.sum("n")).first()[0] or 0) // MOST_WINDOWS) or 1
    while True:  # parts are dealt to passes by a hash; if one gets too much, there are more passes
        dealt = parts.withColumn("pass", F.pmod(F.xxhash64("i", "k"), F.lit(passes)))
        if passes == 1 or dealt.groupBy("pass").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= MOST_WINDOWS:
            break
        passes += -(-passes // 4)
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for k in range(passes):  # each pass keeps the text for the next and adds its spans
        out = _search(out, dealt.where(F.col("pass") == k), window, docs, keep=k < passes - 1)
        out = cut(out) if k < passes - 1 else out
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _search(docs: DataFrame, parts: DataFrame, window: int, origin: DataFrame, keep: bool = False) -> DataFrame:
    shared = origin.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.i, bytes(r.t)) for r in parts.select("i", "t").collect()]))
    prior = "spans" in docs.columns
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ("text string, " if keep else "") + SCHEMA

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = cache_of("decontam")  # the tables of one pass, for all of this worker's tasks
        if not kept or kept[0] != shared.value[0]:
            kept[:] = [shared.value[0], Benchmark(shared.value[1], window)]
        for batch in batches:
            for part in slices(batch, "text", 4 << 20) if batch.num_rows else []:
                data, off, _ = raw(part.column("text"))
                whole = data.tobytes()
                texts = [normal(whole[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                n, spans, found = kept[1].hits(texts)
                if prior:
                    for k, (old, ids) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)):
                        spans[k] = _merge([*spans[k], *((x["first"], x["end"]) for x in old)])
                        found[k] |= set(ids)
                hit = [sum(b - a for a, b in s) for s in spans]
                cols = [part.column("doc_id"), *([part.column("text")] if keep else []), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(["text"] if keep else []), "n_words", "n_hit", "items", "spans"])

    return docs.mapInArrow(run, schema)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def items_digest(items) -> str:
    """Lowercase hex SHA-256 of the comma-joined ids."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
