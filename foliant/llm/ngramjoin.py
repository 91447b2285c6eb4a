"""Exact Jaccard self-join of documents on word n-grams, by partitioning the universe of n-grams into segments.

Sets in a band of sizes are cut into segments by a hash of each n-gram. Two sets of a band, or of neighbouring bands,
that reach the threshold differ in at most H n-grams, so with H + 1 segments at least one is equal (threshold 0), and a
segment that counts twice may differ by one n-gram (threshold 1: equal, or equal after one deletion on a side). Per band,
costs decide how many segments count twice. A set skips (threshold -1) its first empty segments, the frequent signature,
up to a number that costs decide too, and the band has as many more segments: of the segments in which two near sets are
equal, one more than that number, the last is skipped by neither. Candidates are verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MOST_BITS, U64, Rolling, bitmap, cache_of, cut, dropped, held, mix, parts, raw, runs, slices, stored, tidy, work_dir

#: Numbers of empty segments that a band's sets may skip.
SLACKS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ROLL = Rolling(7)
_MULT = mix(np.arange(11, 11 + 16, dtype=np.uint64)) | U64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each text the sorted distinct hashes of its word n-grams; fewer words make one n-gram, none makes none."""
    folded = _FOLD[data]
    space = _SPACE[folded]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    starts_doc = off[:-1][off[:-1] < off[1:]]
    first[starts_doc] = inside[starts_doc]
    last = inside.copy()
    last[:-1] &= space[1:]
    ends_doc = starts_doc if not len(starts_doc) else off[1:][off[:-1] < off[1:]] - 1
    last[ends_doc] = inside[ends_doc]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = _ROLL.prefix(folded)
    word = _ROLL.of(prefix, a, b)
    word_off = np.searchsorted(a, off)
    count = np.diff(word_off)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = runs(word_off[:-1], made)
    size = np.repeat(np.minimum(count, n), made)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        live = size > k
        h[live] += word[at[live] + k] * _MULT[k % 16] + U64(k // 16)
    h = mix(h ^ mix(size.astype(np.uint64)))
    doc = np.repeat(np.arange(len(made)), made)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(made) + 1))


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int  # with threshold 0
    double: int  # with threshold 1
    slack: int = 0  # empty segments that a set skips


class Bands:
    """Bands of set sizes and, for each, the layout that costs least for the number of sets in it."""

    def __init__(self, num: int, den: int, counts: dict[int, int] | None = None):
        self.num, self.den, self.counts = num, den, counts or {}
        self.low = [1]

    def index(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * self.den // self.num + 1))
        return int(np.searchsorted(self.low, size, "right")) - 1

    def band(self, k: int) -> Band:
        self.index(self.low[-1])
        while len(self.low) <= k + 1:
            self.index(self.low[-1])
        low, high = self.low[k], self.low[k + 1] - 1
        most = high * self.den // self.num  # the largest partner
        # |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|)
        h = (self.den - self.num) * (high + most) // (self.den + self.num)
        n = self.counts.get(k, 0) + self.counts.get(k + 1, 0)
        best = None
        for double, slack in [*((0, s) for s in SLACKS), *((d, 0) for d in sorted({(h + 1) // 4, (h + 1) // 2} - {0}))]:
            single = h + 1 - 2 * double + slack
            q = (low + high) / 2 / (single + 2 * double)  # n-grams of a segment that counts once
            rows = single + double * (1 + 2 * q)
            # that two sets without anything in common meet: both empty, or, after a deletion, of at most one n-gram
            empty = single * (_beyond(single * math.exp(-q), slack) / max(single, 1)) ** 2
            cost = rows + 2 * n * (empty + double * math.exp(-4 * q) * (1 + 2 * q) ** 2)
            if best is None or cost < best[0]:
                best = (cost, single, double, slack)
        return Band(low, high, *best[1:])


def _beyond(mean: float, k: int) -> float:
    """The expected excess over k of a Poisson number."""
    p, out = math.exp(-mean), mean - k
    for x in range(k):
        out += (k - x) * p
        p *= mean / (x + 1)
    return max(0.0, out)


def sketches(h: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """Of each set the parities of its n-grams' counts in hash slots, a power of two of them, two or more for each n-gram.

    An n-gram that only one of two sets has changes one parity, so sketches never differ more than their sets do.
    """
    size = np.diff(edge)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    slot = (mix(h ^ U64(0x0F0F0F0F0F)) & np.repeat((bits - 1).astype(np.uint64), size)).astype(np.int64)
    flat = np.packbits((np.bincount(np.repeat(base[:-1], size) + slot, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    return [flat[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def fold(sketch: bytes, length: int) -> np.ndarray:
    """The sketch with fewer slots: the parities of slots that fall together."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, length // 8), 0)


def signatures(sets: np.ndarray, band: Band, salt: int) -> np.ndarray:
    """Distinct signatures of one set under a band's layout."""
    m = band.segments + band.double
    # segments that count twice take a double share of the universe
    share = band.segments + 2 * band.double
    slot = ((mix(sets ^ U64(0xA5A5A5A5)) >> U64(32)) * U64(share) >> U64(32)).astype(np.int64)
    seg = np.where(slot < band.segments, slot, band.segments + (slot - band.segments) // 2)
    order = np.argsort(seg, kind="stable")
    s, g = sets[order], seg[order]
    v = mix(s + U64(0x1234567))
    total = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    edge = np.searchsorted(g, np.arange(m + 1))
    sums = total[edge[1:]] - total[edge[:-1]]
    where = mix(np.arange(m, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(salt))
    size = np.diff(edge)
    use = np.ones(m, bool)
    use[np.flatnonzero(size[: band.segments] == 0)[: band.slack]] = False
    out = [mix(sums[use] ^ where[use])]
    if band.double:
        tail = edge[band.segments]
        g2 = g[tail:]
        out.append(mix((sums[g2] - v[tail:]) ^ where[g2]))
    return np.unique(np.concatenate(out))


def _by_band(counts: dict[int, int], num: int, den: int):
    bands = Bands(num, den, counts)
    made: dict[int, Band] = {}

    def layout(k: int) -> Band:
        if k not in made:
            made[k] = bands.band(k)
        return made[k]

    return bands, layout


def components(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Two rows link if the Jaccard similarity of their sets is at least threshold (numerator, denominator). Null and empty
    texts have no n-gram and link with nothing. A 64-bit hash stands for an n-gram and 128 bits for a set. Equal sets, repeated rows among them, form one class, which one of them
    stands for in the join. A null doc_id takes no part as a reached id: a row that has one links as others do, by a key of
    its text, and gets the smallest id that its links reach, or null. Rows that share a doc_id are one document with all
    their sets.
    Other columns are ignored; an empty table gives no rows.
    """
    num, den = threshold

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("ngramjoin")
        bands = Bands(num, den)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20) if batch.num_rows else []:
                data, off, _ = raw(part.column("text"))
                h, edge = shingle_sets(data, off, n)
                size = np.diff(edge)
                total = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(mix(h + U64(5)), out=total[0, 1:])
                np.cumsum(mix(h ^ U64(0x77777777777)), out=total[1, 1:])
                fp = total[:, edge[1:]] - total[:, edge[:-1]]
                band = [bands.index(int(s)) if s else -1 for s in size]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(band, pa.int32()), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), pa.array(sketches(h, edge), pa.binary()), part.column("named")], ["doc_id", "n_shingles", "band", "f1", "f2", "sketch", "named"])

    real, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    base = docs.select(F.coalesce(real, F.xxhash64(F.lit("no id"), text)).alias("doc_id"), text.alias("text"), real.isNotNull().alias("named"))
    rows = cut(base.mapInArrow(measure, "doc_id long, n_shingles long, band int, f1 long, f2 long, sketch binary, named boolean"))
    own = F.when(F.col("named"), F.col("doc_id"))
    # a row with an id stands for its class if there is one
    rep = F.min(F.struct(~F.col("named"), "doc_id"))["doc_id"].alias("rep")
    classes = held(rows.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(rep, F.min(own).alias("least"), F.first("band").alias("band"), F.first("sketch").alias("sketch")))
    counts = {r.band: r["n"] for r in classes.groupBy("band").agg(F.count("*").alias("n")).collect()}  # a row a band
    merged = _roots(_one_of_each(base, classes), classes, counts, n, num, den)
    member = classes.join(merged, classes["rep"] == merged["node"], "left").select("f1", "f2", F.col("n_shingles").alias("m"), F.coalesce("root", "rep").alias("root"), "least")
    member = cut(member)
    # keys of rows without an id are no ids: of each component the smallest real id, if it has one
    lowest = member.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("root"))
    member = member.withColumnRenamed("root", "r").join(lowest, "r").select("f1", "f2", "m", "root")
    one = F.when(F.col("n_shingles") > 0, F.col("n_shingles"))
    out = rows.alias("r").join(member.alias("c"), (F.col("r.f1") == F.col("c.f1")) & (F.col("r.f2") == F.col("c.f2")) & (one == F.col("c.m")), "left")
    return out.select(own.alias("doc_id"), "n_shingles", F.coalesce("root", own).alias("component_id"))


def _one_of_each(base: DataFrame, classes: DataFrame) -> DataFrame:
    """base, of whose rows without an id one stays for each class that has no row with an id."""
    alone = classes.where("least is null").select("rep").distinct()
    nameless = base.where("not named").join(alone, F.col("doc_id") == F.col("rep"), "left_semi")
    nameless = nameless.groupBy("doc_id").agg(F.min("text").alias("text"))
    return base.where("named").select("doc_id", "text").unionByName(nameless)


def _roots(base: DataFrame, classes: DataFrame, counts: dict[int, int], n: int, num: int, den: int) -> DataFrame:
    """(node, root) of the class representatives that links join."""
    spark = base.sparkSession

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("ngramjoin")
        bands, layout = _by_band(counts, num, den)
        for batch in batches:
            if known is not None and batch.num_rows:
                batch = batch.filter(pa.array(known.value.has(np.asarray(batch.column("key")).view(np.uint64))))
            for part in slices(batch, "text", 1 << 20) if batch.num_rows else []:
                data, off, _ = raw(part.column("text"))
                h, edge = shingle_sets(data, off, n)
                ids = np.asarray(part.column("doc_id"))
                sigs, who, size = [], [], np.diff(edge)
                for i in np.flatnonzero(size):
                    s = h[edge[i] : edge[i + 1]]
                    k = bands.index(int(size[i]))
                    for scheme in (k, k - 1) if k else (k,):
                        got = signatures(s, layout(scheme), scheme)
                        sigs.append(got)
                        who.append(np.full(len(got), i))
                if sigs:
                    w = np.concatenate(who)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(ids[w]), pa.array(size[w].astype(np.int32))], ["sig", "id", "size"])

    # Only representatives sign. A bitmap tells them where texts are read, as far as it can tell them apart; the few others that
    # it lets through come after their own representative in each run, and have no shape below. Beyond that a join tells them.
    reps = cut(classes.select("rep").distinct())
    fits = reps.count() * 16 <= MOST_BITS
    known = spark.sparkContext.broadcast(bitmap(reps.select(F.xxhash64("rep").alias("key")))) if fits else None

    def signed(of: DataFrame) -> DataFrame:
        of = of if fits else of.join(reps, F.col("doc_id") == F.col("rep"), "left_semi")
        return of.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(sign, "sig long, id long, size int")

    @tidy
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within each run of equal (sig, salt): every member with the run's first; of a run that is dealt out, also its first with itself."""
        head = None
        for batch in batches:
            sig, ids, size, salt = (np.asarray(batch.column(k)) for k in range(4))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
            if head is not None and (sig[0], salt[0]) == head[:2]:
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            hub = np.where(at >= 0, ids[at], head[2] if head is not None else 0)
            hub_size = np.where(at >= 0, size[at], head[3] if head is not None else 0)
            k = at[-1]
            if k >= 0:
                head = (sig[k], salt[k], ids[k], size[k])
            yes = (hub != ids) | (salt > 0)
            fits = np.minimum(size, hub_size)[yes] * den >= np.maximum(size, hub_size)[yes] * num
            yield pa.RecordBatch.from_arrays([pa.array(sig[yes]), pa.array(hub[yes]), pa.array(ids[yes]), pa.array(size[yes]), pa.array(fits)], ["sig", "a", "b", "size", "fits"])

    # A signature of so many sets that one task would get much more than others is dealt out: each share has its own first,
    # and these firsts meet again. A sample of the sets finds such signatures; it decides where rows go, not what comes out.
    some = held(signed(base.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)).groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"))
    total = some.agg(F.sum("n")).first()[0] or 0
    often = some.where(F.col("n") >= max(LEAST_OFTEN, total // (8 * parts(spark)))).orderBy(F.desc("n")).limit(MOST_OFTEN).select("sig", F.least(F.lit(1 << 10), F.ceil(F.col("n") * SAMPLE / RUN_SHARE)).cast("int").alias("shares"))
    rows = signed(base).join(F.broadcast(often), "sig", "left")  # at most MOST_OFTEN rows
    rows = rows.select("sig", "id", "size", F.coalesce(1 + F.pmod(F.xxhash64("id"), "shares"), F.lit(0)).cast("int").alias("salt"))
    hit = rows.repartition(parts(spark), "sig", "salt").sortWithinPartitions("sig", "salt", "id").mapInArrow(pair, "sig long, a long, b long, size int, fits boolean")
    hit = held(hit)  # a row for each member of a run beyond its first, or of a share's
    firsts = hit.where("a = b").select("sig", "a", "size")
    top = firsts.groupBy("sig").agg(F.min(F.struct("a", "size")).alias("top"))
    close = F.least("size", "top.size") * den >= F.greatest("size", "top.size") * num
    over = firsts.join(top, "sig").where("a <> top.a").select("sig", F.col("top.a").alias("a"), F.col("a").alias("b"), close.alias("fits"))
    star = held(hit.where("a <> b").select("sig", "a", "b", "fits").unionByName(over))
    shape = classes.select(F.col("rep").alias("id"), "n_shingles", "sketch")
    tried = star.where("fits").groupBy("a", "b").agg(F.count("*").alias("w"))
    x, y = (shape.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    tried = held(tried.join(x, "a").join(y, "b").mapInArrow(near_sketches(num, den), "a long, b long, w long"))
    sets = _sets(base, tried, n)
    links = held(verify(sets, tried.select("a", "b"), num, den))
    roots = connect(links)
    # Runs whose members are still of several components: every pair across them whose sketches allow it and that has not
    # met yet. Sets that are near without a link share many runs, so they meet by the first few signatures of each set
    # (by a hash, the same order for all), and then, in what is left, by all.
    members = held(star.select("sig", F.col("a").alias("id")).union(star.select("sig", F.col("b").alias("id"))).distinct())
    order = W.partitionBy("id").orderBy(F.xxhash64("sig"), "sig")
    few = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST_RUNS).select("sig", "id")
    met = tried.select("a", "b")
    for some in (few, members):
        found = held(_across(some, roots, shape, _apart(met, roots), num, den))
        if found.take(1):
            met = met.unionByName(found)
            new = held(verify(_sets(base, found, n), found, num, den))
            if new.take(1):
                links = links.unionByName(new)
                roots = connect(links)
    return roots


def _across(members: DataFrame, roots: DataFrame, shape: DataFrame, met: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a run and of different components whose sketches allow a link, but for those that have met."""
    members = held(members.join(roots, members["id"] == roots["node"], "left").select("sig", "id", F.coalesce("root", "id").alias("root")))
    still = members.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2")  # a pair has met
    known = met.groupBy(F.greatest("a", "b").alias("id")).agg(F.collect_set(F.least("a", "b")).alias("met"))  # near sets without a link, of smaller id
    still = members.join(still.select("sig", "n"), "sig").join(shape.join(known, "id", "left"), "id")
    blocks = F.ceil(F.col("n") / RUN_BLOCK).cast("int")  # a long run is dealt as pairs of blocks
    still = still.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    still = still.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    still = still.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "root", F.col("n_shingles").alias("size"), "sketch", "met")
    still = still.repartition(parts(members.sparkSession), "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "id")
    return still.mapInArrow(across_runs(num, den), "a long, b long").distinct()


#: Runs of each set in which pairs across components meet first.
FIRST_RUNS = 4
#: One set of so many tells which signatures are frequent; those that LEAST_OFTEN and more have, at most MOST_OFTEN, are dealt out, by about RUN_SHARE sets.
SAMPLE, LEAST_OFTEN, MOST_OFTEN, RUN_SHARE = 32, 64, 10_000, 4_096
#: Members of a run that one task compares with each other, or with as many of another block.
RUN_BLOCK = 256


def allowed(na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most n-grams in which sets of these sizes may differ at the threshold."""
    return (den - num) * (na + nb) // (den + num)


def near_sketches(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = allowed(np.asarray(batch.column("na")), np.asarray(batch.column("nb")), num, den)
            keep = []
            for a, b, m in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), most.tolist(), strict=True):
                size = min(len(a), len(b))
                keep.append(int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum()) <= m)
            yield batch.select(["a", "b", "w"]).filter(pa.array(keep, pa.bool_()))

    return run


def across_runs(num: int, den: int):
    """Pairs of one run, of different components, whose sizes and sketches allow a link."""

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, roots, size = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        if len(ids) < 2:
            return
        known = [frozenset(r[4] or ()) for r in rows]
        length = min(len(r[3]) for r in rows)
        sk = np.stack([fold(r[3], length) for r in rows])
        for k in range(len(ids) - 1):
            most = allowed(size[k], size[k + 1 :], num, den)
            ok = (roots[k + 1 :] != roots[k]) & (np.minimum(size[k], size[k + 1 :]) * den >= np.maximum(size[k], size[k + 1 :]) * num)
            at = np.flatnonzero(ok)
            at = at[np.bitwise_count(sk[k + 1 + at] ^ sk[k]).sum(1, dtype=np.int64) <= most[at]]
            at = np.array([x for x in at.tolist() if rows[k][0] not in known[k + 1 + x]], np.int64)
            if len(at):
                a, b = np.full(len(at), ids[k]), ids[k + 1 + at]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for sig, i, j, *row in zip(*(batch.column(k).to_pylist() for k in ("sig", "i", "j", "id", "root", "size", "sketch", "met")), strict=True):
                if (sig, i, j) != key:
                    yield from compare(rows)
                    key, rows = (sig, i, j), []
                rows.append(row)
        yield from compare(rows)

    return run


#: A bitmap of ids that is broadcast has at most so many bits (8 MB), whatever the number of ids.
ID_BITS = 1 << 26


def _sets(base: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(id, set): the sorted hashes of the documents of pairs (a, b), held in the shared folder. A bitmap drops most others where they are read."""
    ids = held(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    known = base.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("id").alias("key")), ID_BITS))

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(known.value.has(np.asarray(batch.column("key")).view(np.uint64)))) if batch.num_rows else batch
            for part in slices(batch, "text", 1 << 20) if batch.num_rows else []:
                data, off, _ = raw(part.column("text"))
                h, edge = shingle_sets(data, off, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * 8).astype(np.int32)), pa.py_buffer(h)])], ["i", "set"])

    found = base.withColumn("key", F.xxhash64("doc_id")).mapInArrow(gather, "i long, set binary")
    return cut(found.join(ids, F.col("i") == F.col("id"), "left_semi").select(F.col("i").alias("id"), "set"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sides are not of one component."""
    p = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    return p.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def verify(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge: root is the smallest node that edges reach.

    Each round every node that has a smaller neighbour goes to the smallest, and on to where that one goes, until it comes to a
    node that has none; edges are then renamed, and those within one node are gone. So a round sees only what is still apart,
    and all rounds together make little more rows than the first. What a round makes is written to the shared folder.
    """
    spark, path, k = edges.sparkSession, work_dir(edges.sparkSession, "links"), 0

    def links(pairs: DataFrame) -> DataFrame:
        return stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/links-{k}")

    left, gone = links(edges.select("a", "b")), None
    while left.take(1):
        k += 1
        up = _ends(left.groupBy("a").agg(F.min("b").alias("to")), f"{path}/ends-{k}")
        over = up.select(F.col("a").alias("b"), F.col("to").alias("over"))
        left = links(left.join(up, "a").select(F.col("to").alias("a"), "b").join(over, "b", "left").select("a", F.coalesce("over", "b").alias("b")))
        dropped(spark, f"{path}/links-{k - 1}")
        moved = up.select(F.col("a").alias("node"), F.col("to").alias("root"))
        if gone is not None:
            then = gone.join(up.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            moved = then.unionByName(moved)
        gone = stored(moved, f"{path}/gone-{k}")
        dropped(spark, f"{path}/gone-{k - 1}")
        dropped(spark, f"{path}/ends-{k}")
    if gone is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return gone.unionByName(gone.select(F.col("root").alias("node"), "root").distinct())


def _ends(up: DataFrame, path: str) -> DataFrame:
    """(a, to) with each `to` replaced by where the steps from it end; they must not run in circles. Distances double each round."""
    up, k = stored(up, f"{path}/0"), 0
    while True:
        k += 1
        over = up.select(F.col("a").alias("to"), F.col("to").alias("over"))
        further = stored(up.join(over, "to", "left").select("a", F.coalesce("over", "to").alias("to"), F.col("over").isNotNull().alias("went")), f"{path}/{k}")
        dropped(up.sparkSession, f"{path}/{k - 1}")
        up = further.select("a", "to")
        if not further.where("went").take(1):
            return up
