"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Each source's documents are shuffled by a hash of their id and repeated in that order, pass after pass. A copy's virtual
finish time is the number of its source's words up to its end, divided by the source's target; the mix is the global
order by finish time, cut where the total budget is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Finish times are first summed in this many bins a unit, twice; times above LAST share the last bin.
BINS, LAST = 1 << 12, 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> also target.

    Sources in order of their code points, null last, weigh `weights`, repeating. They share `share` times all sizes by
    weight; a target stops at `most` times its source's size, and what it can't take is shared again, until none is
    above. That is the level L at which the sum of least(weight * L, most * source_size) is the budget: with the
    sources in order of most * source_size / weight, those before some place stop, and L is what is left over the
    weights of the others: the largest such quotient that stops no source at or after its place. One row for each source, so these windows hold sources, not documents.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    a = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.get(a, (F.row_number().over(by_name) - 1) % len(weights)).cast("double"))
    s = s.withColumn("stop", F.lit(most) * F.col("source_size")).withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
    order = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("gone", F.coalesce(F.sum("stop").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.col("budget") - F.col("gone")) / F.col("left"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))).over(W.partitionBy())
    return s.withColumn("target", F.least(F.coalesce(level * F.col("weight"), F.col("stop")), F.col("stop"))).select("source", "source_size", "target", "budget")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row of docs: doc_id, source, size, source_size, target, copies, taken.

    Null text has size 0 and is taken with no word; null source is a source of its own; null doc_id is shuffled as an
    empty id. Rows of one doc_id keep an order by size, so equal rows get equal results up to their order. Other columns
    are ignored; an empty table gives no rows. Whole documents are taken, so a source may miss its target by less than one
    document, and no document is taken more than `most` times. The order is the same at each run.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    base = cut(base.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))
    base = base.withColumn("b", F.substring("h", 1, 3))
    # words of each source before each of its 4096 parts of the shuffle, so that no window holds a whole source
    buckets = base.groupBy("source", "b").agg(F.sum("size").alias("bs"))
    earlier = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    buckets = cut(buckets.withColumn("before", F.coalesce(F.sum("bs").over(earlier), F.lit(0))))
    goals = targets(buckets.groupBy("source").agg(F.sum("bs").alias("source_size")), weights, share, most).withColumnRenamed("source", "g")
    places = buckets.join(goals, F.col("source").eqNullSafe(F.col("g"))).select(F.col("source").alias("s"), F.col("b").alias("sb"), "before", "source_size", "target", "budget")
    inside = W.partitionBy("source", "b").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
    rows = base.withColumn("within", F.sum("size").over(inside)).join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("sb")))
    rows = cut(rows.select("doc_id", "source", "size", "source_size", "target", "budget", "h", (F.col("before") + F.col("within")).alias("cum")))

    def finish(k: int) -> Column:
        return F.when(F.col("target") > 0, (F.col("cum") + k * F.col("source_size")) / F.col("target")).otherwise(F.lit(float(LAST)))

    def key(t: Column, k: Column) -> Column:
        return F.struct(t.alias("t"), F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"), k.alias("pass"), F.col("h"))

    at = F.explode(F.array(*[F.struct(F.lit(k).alias("pass"), finish(k).alias("t")) for k in range(most)]))
    copies = rows.where("size > 0").select("doc_id", "source", "size", "h", "budget", at.alias("c")).select("*", "c.pass", "c.t")
    copies = copies.withColumn("bin", F.floor(F.least("t", F.lit(float(LAST))) * (BINS * BINS)).cast("long"))
    edge = _edge(copies, key(F.col("t"), F.col("pass")))

    def taken(k: int) -> Column:
        if edge is None:
            return F.lit(1)
        last = F.struct(F.lit(edge.t).alias("t"), F.lit(edge.n).alias("n"), F.lit(edge.s).alias("s"), F.lit(edge["pass"]).alias("pass"), F.lit(edge.h).alias("h"))
        return (key(finish(k), F.lit(k)) <= last).cast("int")

    times = F.when(F.col("size") > 0, sum((taken(k) for k in range(1, most)), taken(0))).otherwise(F.lit(1))
    out = rows.withColumn("copies", times).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def _edge(copies: DataFrame, key: Column) -> Row | None:
    """The last copy in the global order that the budget holds; None if it holds all.

    Sums by bins of the finish time find the bin in which the budget ends, then its part; only the copies in that part,
    a 2**24th of a unit, are put in order.
    """
    done = 0
    for size in (BINS, 1):
        bins = copies.groupBy(F.floor(F.col("bin") / size).alias("b")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"))
        run = bins.withColumn("run", F.lit(done) + F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, 0)))
        hit = run.where(F.col("run") > F.col("budget")).orderBy("b").first()
        if hit is None:
            return None
        done = hit.run - hit.n
        earlier, copies = copies.where(F.floor(F.col("bin") / size) < hit.b), copies.where(F.floor(F.col("bin") / size) == hit.b)
        if size == BINS:
            before = earlier
        else:
            before = before.unionByName(earlier)
    ordered = copies.select(key.alias("k"), "size", "budget").withColumn("run", F.lit(done) + F.sum("size").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)))
    inside = ordered.where(F.col("run") <= F.col("budget")).agg(F.max("k").alias("k")).first().k
    if inside is None:
        inside = before.agg(F.max(key).alias("k")).first().k
    return inside if inside is not None else Row(t=-1.0, n=False, s="", h="", **{"pass": 0})


def mixed_documents(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it (`mix`: what mix_sources gives for docs).

    Documents are told apart by id and size; of several with the same, each gets the largest number of copies among them.
    """
    times = mix.groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size")).agg(F.max("copies").alias("__copies")).where("__copies > 0")
    joined = docs.join(times, F.col(id_col).eqNullSafe(F.col("__id")) & (n_words(F.col(text_col).cast("string")) == F.col("__size")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*[docs[c] for c in docs.columns])
