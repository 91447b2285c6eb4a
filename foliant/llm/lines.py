"""Fuzzy line dedup in DataFrame functions only: SimHash of normalised lines, pigeonhole blocks, edit similarity, groups.

Lines that are equal when normalised are one line. A line's SimHash has 64 bits: for each bit, whether most of its words' hashes
have it. Two hashes that differ in at most DISTANCE bits agree in BLOCKS - DISTANCE of BLOCKS blocks, so lines meet by each
choice of that many blocks. In a run of lines that agree, each meets the run's first; what is left apart after that meets all
of the run's other groups. Lines that meet are linked if their edit similarity, 1 - distance / longer length, is at least 0.8.
"""

from __future__ import annotations

import functools
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, dropped, release, stored, work_dir
from .ngramjoin import connect

DISTANCE, SIMILARITY = 3, (4, 5)
#: Parts of the largest distance allowed that are tried in turn.
BANDS = (16, 4, 1)
#: Lines under test are first found by a broadcast bitmap of at most so many words of 64 bits.
BITMAP_WORDS = 1 << 18
#: Words whose bits one sum of 8-bit lanes can count, with room for the comparison.
PIECE = 127
_LANES = 0x0101010101010101
#: Lines in a run above which these don't meet all of it, but those that agree in every fourth bit too.
BIG = 512


def normalised(line: Column) -> Column:
    """Lower case, letters and digits only, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lane(h: Column, k: int) -> Column:
    """Bits k, k + 8, ... of a hash, each in a lane of its own."""
    return F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))


def _above_half(n: Column, sums: list[Column]) -> Column:
    """For each of 64 bits, whether more than half of n hashes have it, n at most PIECE; eight counts are in each of eight sums."""
    least = F.lit(PIECE).cast("long") - F.shiftrightunsigned(n, 1)
    out = None
    for k, s in enumerate(sums):  # bit 0 of each lane: whether its count is above half; the top lane apart, as a long has a sign
        low = F.shiftrightunsigned(s.bitwiseAND(F.lit((1 << 56) - 1)) + least * F.lit(_LANES >> 8), 7).bitwiseAND(F.lit(_LANES >> 8))
        above = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(s, 56) + least, 7), 56))
        out = F.shiftleft(above, k) if out is None else out.bitwiseOR(F.shiftleft(above, k))
    return out


def _majority(hashes: Column) -> Column:
    """For each of 64 bits, whether more than half of at most PIECE hashes have it."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("long").alias(f"s{k}") for k in range(8)])

    def add(a: Column, h: Column) -> Column:
        return F.struct((a["n"] + 1).alias("n"), *[(a[f"s{k}"] + _lane(h, k)).alias(f"s{k}") for k in range(8)])

    return F.aggregate(hashes, zero, add, lambda a: _above_half(a["n"], [a[f"s{k}"] for k in range(8)]))


def _pieces(hashes: Column) -> Column:
    """The majorities of runs of PIECE hashes."""
    at = F.sequence(F.lit(0), F.ceil(F.size(hashes) / PIECE).cast("int") - 1)
    return F.transform(at, lambda i: _majority(F.slice(hashes, i * PIECE + 1, F.lit(PIECE))))


def simhash(text: Column) -> Column:
    """SimHash of the words of a normalised line; a line of more than PIECE words has the majority of its pieces' (and so on)."""

    def of(h: Column) -> Column:
        n = F.size(h)
        deep = lambda f: _let(_pieces(h), f)
        return F.when(n <= PIECE, _majority(h)).when(n <= PIECE * PIECE, deep(_majority)).otherwise(deep(lambda g: _let(_pieces(g), _majority)))

    return _let(F.transform(F.split(text, " "), lambda w: F.xxhash64(w)), of)


def with_simhash(lines: DataFrame, norm: str = "norm") -> DataFrame:
    """lines without the column norm, and with `sim`, its `simhash`: words are rows that are summed up, not folded one by one.

    Each row is known by a number, so rows that repeat are summed apart.
    """
    keep = [c for c in lines.columns if c != norm]
    words = lines.select(F.monotonically_increasing_id().alias("_row"), *keep, F.split(norm, " ").alias("_words"))
    words = words.select("_row", *keep, (F.size("_words") > PIECE).alias("_long"), F.posexplode("_words").alias("_at", "_word"))
    words = words.select("_row", *keep, "_long", F.floor(F.col("_at") / PIECE).cast("int").alias("_piece"), F.xxhash64("_word").alias("_h"))
    sums = words.groupBy("_row", *keep, "_long", "_piece").agg(F.count("*").alias("_n"), *[F.sum(_lane(F.col("_h"), k)).alias(f"_s{k}") for k in range(8)])
    sums = sums.select(F.when(F.col("_long"), F.col("_row")).alias("_row"), *keep, "_long", "_piece", _above_half(F.col("_n"), [F.col(f"_s{k}") for k in range(8)]).alias("sim"))
    sums = stored(sums, work_dir(lines.sparkSession, "simhash"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("_piece", "sim"))), lambda p: p["sim"])
    pieces = sums.where("_long").groupBy("_row", *keep).agg(in_order.alias("_sims"))
    deep = F.when(F.size("_sims") <= PIECE, _majority(F.col("_sims"))).otherwise(_let(_pieces(F.col("_sims")), _majority))
    return sums.where("not _long").select(*keep, "sim").unionByName(pieces.select(*keep, deep.alias("sim")))


def layout(n: int) -> tuple[int, list[tuple[int, ...]]]:
    """Blocks to cut 64 bits into, and the choices of blocks of which one at least agrees within DISTANCE; least cost for n lines.

    Every layout finds the same pairs; more blocks make longer keys, and so fewer chance meetings, of more rows.
    """
    best = None
    for blocks in range(DISTANCE + 1, 9):
        choices = list(combinations(range(blocks), blocks - DISTANCE))
        cost = len(choices) * (1 + n / 2.0 ** (64 * (blocks - DISTANCE) / blocks))
        if best is None or cost < best[0]:
            best = (cost, blocks, choices)
    return best[1], best[2]


def _near(a: str, b: str) -> Column:
    short, long = F.least(f"{a}.len", f"{b}.len"), F.greatest(f"{a}.len", f"{b}.len")
    return (F.bit_count(F.col(f"{a}.sim").bitwiseXOR(F.col(f"{b}.sim"))) <= DISTANCE) & (short * SIMILARITY[1] >= long * SIMILARITY[0])


def _meetings(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of x and y (key, big, a column with sim of their own name) of one run; where this is big, all those within DISTANCE and some more.

    Of four sets of bits, every fourth each, two hashes within DISTANCE = 3 bits agree in one at least; their rows meet in the first.
    """
    quarters = [0x1111111111111111 << k for k in range(DISTANCE + 1)]
    masks = [F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in quarters]

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        parts = F.array(*[F.xxhash64("key", F.lit(k), F.col(name)["sim"].bitwiseAND(m)) for k, m in enumerate(masks)])
        return rows.where("big").select("*", F.posexplode(parts).alias("nth", "quarter"))

    small = x.where("not big").drop("big").join(y.where("not big").drop("big"), "key")
    differ = F.col("x.sim").bitwiseXOR(F.col("y.sim"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(m) == 0, F.lit(k)) for k, m in enumerate(masks)])
    large = dealt(x, "x").drop("big").join(dealt(y, "y").drop("big"), ["key", "nth", "quarter"]).where(first == F.col("nth"))
    return small.unionByName(large.drop("nth", "quarter"))


def _row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: rows with one key have the same id and text."""
    return F.xxhash64(doc_id.isNull(), doc_id, text)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, line_no, line) of all lines."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), _row_key(F.col(id_col), text).alias("row_key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, line_no, norm) of all lines that hold a letter or digit."""
    lines = _lines(docs, id_col, text_col).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    return lines.select("doc_id", "row_key", "line_no", normalised(F.col("line")).alias("norm"))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key", "line_no")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, line_no, keep) of all lines with a letter or digit: whether it is its group's first by doc_id, row and line.

    Rows that repeat with the same id and text have one row key, and their lines are answered alike.
    """
    found = split_lines(docs, id_col, text_col)
    # two independent hashes stand for a normalised line
    rows = found.select("doc_id", "row_key", "line_no", F.xxhash64("norm").alias("id"), F.crc32(F.col("norm").cast("binary")).alias("c"), F.length("norm").alias("len"), "norm")
    rows = with_simhash(rows)
    release(docs.sparkSession)
    first = F.min(_order()).alias("first")
    # the large frames are Parquet files, which take a fraction of a checkpoint's bytes
    path = work_dir(docs.sparkSession, "lines")
    distinct = stored(rows.groupBy("id", "c").agg(first, F.first("len").alias("len"), F.first("sim").alias("sim")), f"{path}/distinct")
    _, choices = layout(distinct.count())
    blocks = max(max(c) for c in choices) + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]

    def mask(choice: tuple[int, ...]) -> int:
        m = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in choice)
        return m - (1 << 64) if m >= 1 << 63 else m

    keys = F.array(*[F.xxhash64(F.lit(k), F.col("sim").bitwiseAND(F.lit(mask(c)).cast("long"))) for k, c in enumerate(choices)])
    signed = distinct.select("id", "len", "sim", F.explode(keys).alias("key"))
    run = W.partitionBy("key")
    met = signed.withColumn("hub", F.min(F.struct("id", "len", "sim")).over(run)).withColumn("n", F.count("*").over(run)).where("n > 1")
    met = met.select("key", F.struct("id", "len", "sim").alias("x"), "hub", (F.col("n") > BIG).alias("big"))
    met = stored(met.withColumn("ok", _near("x", "hub")), f"{path}/met")
    release(docs.sparkSession)
    star = met.where("ok and x.id <> hub.id").select(F.col("hub.id").alias("a"), F.col("x.id").alias("b")).distinct()
    x, y = met.where("not ok").select("key", "big", "x"), met.select("key", "big", F.col("x").alias("y"), F.col("ok").alias("yo"))
    odd = _meetings(x, y).where((F.col("x.id") < F.col("y.id")) | F.col("yo")).where((F.col("x.id") != F.col("y.id")) & _near("x", "y"))
    others = cut(odd.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    star = cut(star)
    ids = cut(star.union(others).select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = _texts(docs, id_col, text_col, distinct.join(ids, "id", "left_semi").select("id", "first.row_key", "first.line_no"))
    release(docs.sparkSession)
    linked = cut(_linked(star, texts))
    roots = connect(linked)
    # members that both came near their run's first, yet are apart: the edit similarity to it was too small
    who = roots.withColumnsRenamed({"node": "id", "root": "r"})
    near = met.where("ok").select("key", "x", F.col("x.id").alias("id")).join(who, "id", "left").select("key", "x", F.coalesce("r", "id").alias("r"))
    mixed = near.groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo < hi").select("key")
    near = cut(near.join(mixed, "key"))
    dropped(docs.sparkSession, f"{path}/met")
    u, v = near.select("key", "x", F.col("r").alias("rx")), near.select("key", F.col("x").alias("y"), F.col("r").alias("ry"))
    apart = u.join(v, "key").where((F.col("rx") < F.col("ry")) & _near("x", "y")).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    end = lambda k: who.select(F.col("id").alias(k), F.col("r").alias(f"r{k}"))
    open_ = others.join(end("a"), "a", "left").join(end("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    rest = apart.unionByName(open_).distinct().join(star, ["a", "b"], "left_anti")
    roots = connect(cut(linked.unionByName(_linked(rest, texts))))
    release(docs.sparkSession)
    named = distinct.join(roots, distinct["id"] == roots["node"], "left").select("id", "c", "first", F.coalesce("root", "id").alias("root"))
    keepers = named.groupBy("root").agg(F.min("first").alias("keeper"), F.count("*").alias("kinds"))
    named = named.join(keepers, "root").select(F.col("id").alias("i"), F.col("c").alias("d"), "keeper")
    return rows.join(named, (F.col("id") == F.col("i")) & (F.col("c") == F.col("d"))).select("doc_id", "row_key", "line_no", _order().eqNullSafe(F.col("keeper")).alias("keep"))


def _texts(docs: DataFrame, id_col: str, text_col: str, places: DataFrame) -> DataFrame:
    """(id, norm) of the lines under test, read at their places (id, row_key, line_no); other lines are not normalised again."""
    slot = F.pmod(F.xxhash64("row_key", "line_no"), F.lit(BITMAP_WORDS * 64))
    one = F.expr("shiftleft(1L, cast(pmod(xxhash64(row_key, line_no), 64) as int))")
    places = cut(places)
    bits = places.groupBy(F.floor(slot / 64).alias("w")).agg(F.bit_or(one).alias("v"))
    maybe = _lines(docs, id_col, text_col).withColumn("w", F.floor(slot / 64)).join(F.broadcast(bits), "w").where(F.col("v").bitwiseAND(one) != 0)  # at most BITMAP_WORDS rows
    read = maybe.select("row_key", "line_no", normalised(F.col("line")).alias("norm")).join(places, ["row_key", "line_no"])
    return cut(read.groupBy("id").agg(F.min("norm").alias("norm")))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose distance is at most a fifth of the longer line."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("norm").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("norm").alias("y")), "b")
    longest = F.greatest(F.length("x"), F.length("y"))
    most = F.floor(longest * (SIMILARITY[1] - SIMILARITY[0]) / SIMILARITY[1]).cast("int")
    return joined.where(_within(F.col("x"), F.col("y"), most)).select("a", "b")


def _shared(x: Column, y: Column) -> Column:
    """Characters that both begin with, found by halving."""

    def grown(n: Column, k: Column, short: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        same = (n + step <= short) & (F.substring(x, n + 1, step) == F.substring(y, n + 1, step))
        return F.when(same, n + step).otherwise(n)

    def find(short: Column) -> Column:
        steps = F.sequence(F.floor(F.log2(F.greatest(short, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))
        return F.aggregate(steps, F.lit(0), lambda n, k: grown(n, k, short))

    return _let(F.least(F.length(x), F.length(y)), find)


def _aligned(x: Column, y: Column, most: Column) -> Column:
    """Whether changing the words that differ, place by place, takes at most `most` edits: then the edit distance is no greater."""
    changed = F.zip_with(F.split(x, " "), F.split(y, " "), lambda u, v: F.when(u == v, 0).otherwise(F.greatest(F.length(u), F.length(v))))
    same_count = F.length(F.translate(x, " ", "")) - F.length(x) == F.length(F.translate(y, " ", "")) - F.length(y)
    return F.when(same_count, F.aggregate(changed, F.lit(0), lambda a, c: a + c) <= most).otherwise(False)


def _within(x: Column, y: Column, most: Column) -> Column:
    """Whether the edit distance is at most `most`; only what lies between the strings' shared ends is compared, and nothing where words in place prove it."""

    def trimmed(p: Column, then) -> Column:  # reversed, so that the other end comes next
        def tail(s: Column) -> Column:
            return F.reverse(F.substring(s, _shared(p["x"], p["y"]) + 1, F.length(s)))

        return _let(F.struct(tail(p["x"]).alias("x"), tail(p["y"]).alias("y")), then)

    def near(p: Column) -> Column:
        tries = [F.call_function("levenshtein", p["x"], p["y"], F.floor(most / part).cast("int")) >= 0 for part in BANDS]
        return functools.reduce(Column.__or__, tries)

    return _aligned(x, y, most) | _let(F.struct(x.alias("x"), y.alias("y")), lambda p: trimmed(p, lambda q: trimmed(q, near)))


#: Copies of a repeated row that one array may stand for.
RUN = 10_000


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_lines, n_removed, kept (the text without the lines that repeat an earlier one).

    Lines end at a line feed. Lines without a letter or digit are always kept. Null text has no lines and stays null. Rows are
    ordered by doc_id, null last, and rows of one id by a hash of their text; a line goes where an earlier row, or an earlier
    line of its own row, has it. Of rows repeated with the same id and text one counts as the first, and the others lose all
    their lines with a letter or digit. Other columns are ignored; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), _row_key(F.col(id_col), text).alias("row_key"), text.alias("text"))
    gone = line_groups(docs, id_col, text_col).where(~F.col("keep")).groupBy("row_key").agg(F.collect_set("line_no").alias("gone"))
    repeated = cut(base.groupBy("row_key").agg(F.count("*").alias("copies")).where("copies > 1"))
    some = not repeated.isEmpty()

    def shortened(rows: DataFrame, which: str) -> DataFrame:
        at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), which)
        kept = F.when(F.coalesce(F.size(which), F.lit(0)) == 0, F.col("text")).otherwise(F.array_join(F.transform(at, lambda i: F.get("lines", i)), "\n"))
        n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
        return rows.withColumn("lines", F.split("text", "\n")).select("doc_id", n("lines").alias("n_lines"), n(which).alias("n_removed"), kept.alias("kept"))

    if not some:
        return shortened(base.join(gone, "row_key", "left"), "gone")
    once = base.join(repeated, "row_key").groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("copies").alias("copies"))
    out = shortened(base.join(repeated, "row_key", "left_anti").unionByName(once.drop("copies")).join(gone, "row_key", "left"), "gone")
    # the other copies differ in nothing, so they are made from one, RUN at a time
    lines = F.split("text", "\n")
    every = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"[\p{L}\p{N}]"))
    begin = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long")))
    others = once.withColumn("every", F.when(F.col("text").isNotNull(), every)).withColumn("from", begin)
    others = others.withColumn("k", F.explode(F.sequence("from", F.least(F.col("from") + RUN - 1, F.col("copies") - 1))))
    return out.unionByName(shortened(others, "every"))
