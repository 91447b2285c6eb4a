"""An audit of how each source of a language differs from its other sources, and by which terms.

A term's rate in a group is a whole number, 1 + floor(UNIT * (count + 1) / (N + V)): N occurrences of the V terms that its language
keeps. One rate p measures against another q by floor((p - q)^2 / q).

Sums over all kept terms of two sources are sparse: where a term is missing in a source its rate is the source's baseline, which
all its missing terms share. So a sum is V times the baselines' measure, plus what each source's own terms change against the
other's baseline (by the histogram of its counts), plus a correction for terms that both have.

The most telling terms of each group are ranked by radix selection: histograms of some bits of the values, by group, name the bits
of the rank's threshold, from the highest down, and only rows that still tie with it go on. Values that tie at the threshold are
told apart by the bytes of the term in the same way. Then at most a bounded number of rows a group is sorted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, runs, slices, tidy

UNIT = 1_000_000_000
LEAST_DOCS, TOP = 3, 200
#: Distinct (group, term) counts that a task holds before it passes them on.
HELD_TERMS = 300_000
#: Pairs of a term's sources that are measured at a time.
PAIRS = 1 << 20
#: Bits of a value that one histogram looks at; ties of a group up to this number are sorted.
DIGIT, TIES = 16, 4096
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_PIECE = 1 << 20

GROUP = ["lang", "source"]


def _terms(text: memoryview) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size; a piece ends where no term goes on."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + _PIECE)
        piece = bytes(text[at:end]).lower()
        while end < n:  # a term that goes on is taken whole
            more = bytes(text[end : end + 64]).lower()
            tail = _TERM.match(more) if _TERM.match(piece[-1:]) else None
            if not tail:
                break
            piece, end = piece + tail[0], end + len(tail[0])
            if len(tail[0]) < len(more):
                break
        yield _TERM.findall(piece)
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), summed within tasks only; a row without a term for each group that occurs."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                k = len(n)
                columns = [pa.array([lang] * (k + 1)), pa.array([source] * (k + 1)), pa.array([None, *[t.decode() for t in n]], pa.string()), pa.array([0, *n.values()]), pa.array([0, *[d[t] for t in n]])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            held.clear()

        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    n, d = held.setdefault((lang, source), (Counter(), Counter()))
                    before, seen = len(n), set()
                    for words in _terms(memoryview(text.as_buffer())):
                        n.update(words)
                        seen.update(words)
                    d.update(seen)
                    size += len(n) - before
                    if size > HELD_TERMS:
                        yield from flush()
                        size = 0
        yield from flush()

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(26,0)")
    return F.call_function("div", (wide(count) + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(total) + wide(terms)) + 1


def measure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _measure(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_corrections(terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) from (lang, term, source, p, p0): by term, for each two sources that have it, its own measure in place of what the baselines gave; summed within tasks."""
    listed = terms.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("s")).where(F.size("s") > 1).select("lang", "s")
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    @tidy
    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            term = np.repeat(np.arange(len(size)), size)
            lang = b.column(0).take(pa.array(term))
            # the length of the language tells where it ends
            both = pc.binary_join_element_wise(pc.binary_length(lang).cast(pa.string()), lang, flat.field(0), " ").dictionary_encode()
            code = np.asarray(both.indices).astype(np.int64)
            _, seen = np.unique(code, return_index=True)
            names = list(zip(lang.take(pa.array(seen)).to_pylist(), flat.field(0).take(pa.array(seen)).to_pylist(), strict=True))
            few = len(names) ** 2 <= PAIRS
            dense = np.zeros(len(names) ** 2 if few else 0, np.int64)
            p, p0 = np.asarray(flat.field(1)), np.asarray(flat.field(2))
            start = np.concatenate([[0], np.cumsum(size)])
            sums: dict[int, int] = {}
            # each place meets all places of its term; places are taken so many at a time that PAIRS pairs arise, or one alone
            width = np.repeat(size, size).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(width)])
            at = 0
            while at < len(p):
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
                x = np.repeat(np.arange(at, end), width[at:end])
                y = runs(start[term[at:end]], width[at:end])
                x, y = x[x != y], y[x != y]
                v = _measure(p[x], p[y]) - _measure(p[x], p0[y]) - _measure(p0[x], p[y]) + _measure(p0[x], p0[y])
                key = code[x] * len(names) + code[y]
                if few:
                    np.add.at(dense, key, v)
                else:
                    key, inverse = np.unique(key, return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, inverse, v)
                    for k, t in zip(key.tolist(), total.tolist(), strict=True):
                        sums[k] = sums.get(k, 0) + t
                at = end
            if few:
                sums = {k: int(dense[k]) for k in np.flatnonzero(dense).tolist()}
            if sums:
                left, right = [names[k // len(names)] for k in sums], [names[k % len(names)][1] for k in sums]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in left]), pa.array([x[1] for x in left]), pa.array(right), pa.array(list(sums.values()), pa.int64())], schema=schema)

    return listed.mapInArrow(correct, "lang string, source string, item string, value long")


def _threshold(rows: DataFrame, digit: Column, need: str, up: bool) -> DataFrame:
    """(group, digit, before, tied): for each group the digit at which its rows, counted from the best digit on, reach `need`.

    before: rows of better digits. Groups with fewer rows than they need have no line.
    """
    histogram = rows.groupBy(*GROUP, digit.alias("digit")).agg(F.count("*").alias("n"), F.first(need).alias("need"))
    by = W.partitionBy(*GROUP).orderBy(F.asc("digit") if up else F.desc("digit")).rowsBetween(W.unboundedPreceding, 0)
    return histogram.withColumn("upto", F.sum("n").over(by)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select(*GROUP, "digit", (F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("tied"))


def top_by_radix(rows: DataFrame, most: int = TOP, ties: int = TIES) -> DataFrame:
    """Of (lang, source, item, value), values not negative, each group's `most` rows by value descending, then item ascending by its bytes.

    Items of a group differ. A group's rows are counted, not gathered: a histogram has a row for each digit that occurs, and at
    most `most` + `ties` rows of a group are sorted in the end.
    """
    # `few` gets what is surely among the first and groups of few ties; `rows` holds those that tie with the threshold so far, and how many of them are needed
    rows = rows.withColumn("need", F.lit(most).cast("long"))

    def narrowed(rows: DataFrame, digit: Column, up: bool) -> tuple[DataFrame, DataFrame]:
        edge = cut(_threshold(rows, digit, "need", up).withColumnRenamed("digit", "edge"))
        met = rows.withColumn("digit", digit).join(edge, GROUP, "left")
        better = F.col("edge").isNull() | (F.col("digit") < F.col("edge") if up else F.col("digit") > F.col("edge"))
        met = cut(met.where(better | (F.col("digit") == F.col("edge"))).withColumn("better", better))
        rest = met.where("not better").withColumn("need", F.col("need") - F.col("before")).drop("digit", "edge", "before", "better")
        return met.where("better").select(*GROUP, "item", "value"), rest

    few = None
    largest = rows.agg(F.max("value")).head()[0] or 0
    digits = [(F.shiftright(F.col("value"), shift).bitwiseAND(F.lit((1 << DIGIT) - 1)), False) for shift in range(0, max(1, largest.bit_length()), DIGIT)][::-1]
    at, width = 1, 4
    while few is None or not rows.isEmpty():
        if digits:
            digit, up = digits.pop(0)
        else:  # by the next bytes of the item, twice as many each time
            digit, up = F.substring(F.col("item").cast("binary"), at, width), True
            at, width = at + width, width * 2
        better, rows = narrowed(rows.drop("tied"), digit, up)
        better = better.unionByName(rows.where(F.col("tied") <= ties).select(*better.columns))
        few = better if few is None else few.unionByName(better)
        rows = rows.where(F.col("tied") > ties)
    found = few
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), F.col("item").cast("binary"))))
    return ranked.where(F.col("rank") <= most)


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' measures a source against each other source of its language, part 'term' names the terms that it has more of than its language.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those in `least_docs` or more of
    its rows (each row is a document, repeated ones too). Null text, language or source is the empty string. A group without a
    term has pairs; a language with one source has none; an empty table gives no rows. Extra columns are ignored.
    """
    counted = cut(term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    vocabulary = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = cut(counted.where("term is not null").drop("docs").join(vocabulary, ["lang", "term"]))
    langs = kept.groupBy("lang", "term").agg(F.first("all").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select(*GROUP).join(totals, GROUP, "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    one = F.lit(0)
    # a language that keeps nothing has no rates
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, rate(one, F.col("total"), F.col("v"))).otherwise(1)))
    rated = kept.join(groups.drop("p0"), GROUP).withColumn("p", rate(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", rate(F.col("all"), F.col("lang_total"), F.col("v")))
    more = cut(rated.where("p > q").select(*GROUP, F.col("term").alias("item"), measure(F.col("p"), F.col("q")).alias("value")))
    terms = top_by_radix(more, top).select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank")

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select(*GROUP, "v", "p0").join(other, "lang").where("source <> item")
    wide = lambda c: c.cast("decimal(38,0)")
    base = pairs.select(*GROUP, "item", wide(F.col("v") * measure(F.col("p0"), F.col("q0"))).alias("value"))
    histogram = rated.groupBy(*GROUP, "n").agg(F.first("p").alias("p"), F.count("*").alias("k")).join(groups.select(*GROUP, "p0"), GROUP)
    one_sided = histogram.join(other, "lang").where("source <> item")
    f = lambda a, b: measure(F.col(a), F.col(b))
    mine = one_sided.select(*GROUP, "item", wide(F.col("k") * (f("p", "q0") - f("p0", "q0"))).alias("value"))
    theirs = one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), wide(F.col("k") * (f("q0", "p") - f("q0", "p0"))).alias("value"))
    shared = pair_corrections(kept.join(groups, GROUP).select("lang", "term", "source", rate(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0"))
    both = base.unionByName(mine).unionByName(theirs).unionByName(shared.withColumn("value", wide(F.col("value"))))
    summed = both.groupBy(*GROUP, "item").agg(F.sum("value").cast("long").alias("value"))
    rank = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), F.col("item").cast("binary")))
    return summed.select(*GROUP, F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionByName(terms)
