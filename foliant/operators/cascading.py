"""Style chains of any depth, and the layers of formatting that end in what a run shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.running import cut


def style_chains(styles: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc, name, depth, ancestor): each style with its base styles, nearest first; a cycle ends at the style seen before.

    By pointer doubling: with all ancestors less than 2^k away and each style's ancestor at 2^k, one join gives those less than
    2^(k+1) away. Of styles of one name the first counts; a base that isn't defined ends the chain and is part of it; an empty
    base is none; rows without a document or name take no part.
    """
    own = styles.where(F.col(by).isNotNull() & F.col("name").isNotNull())
    one = own.groupBy(by, "name").agg(F.min_by(F.nullif("base_style_name", F.lit("")), "ord").alias("base"))
    base = cut(one.select(by, "name", "base"))
    chains = cut(base.select(by, "name", F.lit(0).alias("depth"), F.col("name").alias("ancestor")))
    jumps, step, size = base.where("base is not null").select(by, F.col("name").alias("ancestor"), F.col("base").alias("far")), 1, chains.count()
    while True:
        further = chains.join(jumps, [by, "ancestor"]).select(by, "name", (F.col("depth") + step).alias("depth"), F.col("far").alias("ancestor"))
        # an ancestor that comes again, in a cycle, counts where it is nearest
        grown = cut(chains.unionByName(further).groupBy(by, "name", "ancestor").agg(F.min("depth").alias("depth")))
        now = grown.count()
        if now == size:
            return chains.select(by, "name", "depth", "ancestor")
        chains, size, step = grown, now, step * 2
        jumps = cut(jumps.join(jumps.select(by, F.col("ancestor").alias("far"), F.col("far").alias("further")), [by, "far"]).select(by, "ancestor", F.col("further").alias("far")))


def cascade(styles: DataFrame, chains: DataFrame, fields: list[str], by: str = "doc_id") -> DataFrame:
    """Each style's fields, those it leaves null taken from its nearest base style that has them."""
    own = styles.where(F.col(by).isNotNull() & F.col("name").isNotNull()).groupBy(by, "name").agg(F.min_by(F.struct(*fields), "ord").alias("s"))
    joined = chains.join(own.select(by, F.col("name").alias("ancestor"), "s.*"), [by, "ancestor"], "left")
    return joined.groupBy(by, "name").agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("depth"))).alias(f) for f in fields])


#: Layers from the weakest to the strongest; a run's own values come after all.
LAYERS = ("table_style", "para_style", "run_style")


def resolved_runs(runs: DataFrame, styles: DataFrame, fields: list[str], defaults: dict[str, Column], by: str = "doc_id", empty: dict[str, object] | None = None) -> DataFrame:
    """runs with each field as it shows: the run's own value, else that of its run, paragraph or table style, else the default.

    runs have a column for each of LAYERS (a style's name, or null) beside their own fields; null is unset. `empty` names a value
    of a field, of colours say, that counts as unset wherever it stands. A layer's value is its style's after the cascade over its
    base styles. A style that isn't defined gives nothing.
    """
    unset = lambda c, f: F.nullif(c, F.lit(empty[f])) if empty and f in empty else c
    bare = styles.select(by, "ord", "name", "base_style_name", *[unset(F.col(f), f).alias(f) for f in fields])
    whole = cut(cascade(bare, style_chains(bare, by), fields, by))
    out = runs
    for layer in LAYERS:
        named = whole.select(by, F.col("name").alias(layer), F.struct(*fields).alias(f"__{layer}"))
        out = out.join(named, [by, layer], "left")
    values = {f: F.coalesce(unset(F.col(f), f), *[F.col(f"__{layer}.{f}") for layer in reversed(LAYERS)], defaults[f]) for f in fields}
    return out.select(*[values[c].alias(c) if c in values else F.col(c) for c in runs.columns])


def used_styles(used: DataFrame, styles: DataFrame, edges: list[str], by: str = "doc_id") -> DataFrame:
    """(doc, name) of all styles that the used ones reach by any of the edge columns (base, next, linked style): a frontier of joins until nothing is new.

    Edges to styles that aren't defined lead nowhere; cycles end by themselves. Beside single edges the frontier takes those of 2,
    4, 8, ... steps along one column, so that a chain costs rounds in proportion to the logarithm of its length.
    """
    known = styles.select(by, "name").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(e).alias("name")) for k, e in enumerate(edges)])).alias("to")
    to = styles.select(by, F.col("name").alias("from"), each).select(by, "from", "to.column", "to.name").where("name is not null").distinct()
    to = cut(to.join(known, [by, "name"], "left_semi").select(by, "from", "column", "name"))
    # of styles of one name one edge a column is followed further: shortcuts stay as many as styles
    jumps, every, step = cut(to.groupBy(by, "from", "column").agg(F.min("name").alias("name"))), to.select(by, "from", "name"), 2
    most = known.groupBy(by).count().agg(F.max("count")).head()[0] or 0
    while step < most:
        next_jumps = jumps.select(by, F.col("from").alias("name"), "column", F.col("name").alias("further"))
        jumps = cut(jumps.join(next_jumps, [by, "name", "column"]).select(by, "from", "column", F.col("further").alias("name")))
        if jumps.isEmpty():
            break
        every, step = every.unionByName(jumps.select(by, "from", "name")), step * 2
    every = cut(every.distinct())
    reached = cut(used.select(by, "name").distinct().join(known, [by, "name"], "left_semi"))
    frontier = reached
    while not frontier.isEmpty():
        found = frontier.withColumnRenamed("name", "from").join(every, [by, "from"]).select(by, "name").distinct()
        frontier = cut(found.join(reached, [by, "name"], "left_anti"))
        reached = cut(reached.unionByName(frontier))
    return reached
