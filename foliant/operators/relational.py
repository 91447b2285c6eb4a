"""Operators on node tables: order, keys and intervals as windows, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import alphabetic, roman


def ordered_text(rows: DataFrame, by: list[str], order: str, text: str, separator: str = "\n") -> DataFrame:
    """One string for each key, the texts in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias("text"))


def document_text(paragraphs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Text of each document: its non-empty body paragraphs, a line each."""
    return ordered_text(paragraphs.where("story = 'body' and text <> ''"), [by], "ord", "text")


def headings(paragraphs: DataFrame, max_level: int = 9) -> DataFrame:
    return paragraphs.where(F.col("is_heading") & (F.col("outline_level") < max_level))


def first_wins(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first: reference definitions, footnotes, styles by name."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(order))).where("__r = 1").drop("__r")


def resolve_references(links: DataFrame, definitions: DataFrame, by: str = "doc_id") -> DataFrame:
    """uri and title of each link's label, by the first definition; links without one keep null."""
    label = lambda c: F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))
    d = first_wins(definitions.withColumn("key", label(F.col("label"))), [by, "key"], "ord").select(F.col(by), "key", "uri", "title")
    return links.withColumn("key", label(F.col("label"))).join(d, [by, "key"], "left").drop("key")


def merge_runs(runs: DataFrame, by: list[str], order: str, font: list[str], text: str = "text") -> DataFrame:
    """Neighbouring runs of one font become one (islands over a running count of changes)."""
    w = W.partitionBy(*by).orderBy(order)
    changed = F.lit(False)
    for f in font:
        changed = changed | ~F.col(f).eqNullSafe(F.lag(f).over(w))
    marked = runs.withColumn("__i", F.sum(F.when(changed | F.lag(F.lit(1)).over(w).isNull(), 1).otherwise(0)).over(w))
    return ordered_text(marked, [*by, "__i", *font], order, text, "").withColumnRenamed("__i", "run")


def visible_runs(inlines: DataFrame, by: list[str], order: str, kind: str = "kind") -> DataFrame:
    """Runs outside field codes: a start opens a code section, a separator or an end closes one, never below none."""
    delta = F.when(F.col(kind) == "field_start", 1).when(F.col(kind).isin("field_separator", "field_end"), -1).otherwise(0)
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    depth = inlines.withColumn("__s", F.sum(delta).over(w))
    depth = depth.withColumn("__d", F.col("__s") - F.least(F.lit(0), F.min("__s").over(w)))
    return depth.where((F.col(kind) == "run") & (F.col("__d") == 0)).drop("__s", "__d")


# Number styles of list levels.
ARABIC, UPPER_ROMAN, LOWER_ROMAN, UPPER_LETTER, LOWER_LETTER, BULLET = 0, 1, 2, 3, 4, 23


def list_numbers(items: DataFrame, by: str = "doc_id", order: str = "ord", start: str = "start_at") -> DataFrame:
    """The running number of each list item: a level counts on until an item of a higher level of its list comes between."""
    w = W.partitionBy(by, "list_id").orderBy(order)
    levels = items
    reset = F.lit(0)
    for k in range(9):  # how often a level above k has been entered so far
        levels = levels.withColumn(f"__b{k}", F.sum(F.when(F.col("level") < k, 1).otherwise(0)).over(w))
        reset = F.when(F.col("level") == k, F.col(f"__b{k}")).otherwise(reset)
    levels = levels.withColumn("__g", reset).drop(*[f"__b{k}" for k in range(9)])
    n = F.row_number().over(W.partitionBy(by, "list_id", "level", "__g").orderBy(order)) + F.col(start) - 1
    return levels.withColumn("number", n.cast("int")).drop("__g")


def list_label(number: Column, style: Column) -> Column:
    return (
        F.when(style == UPPER_ROMAN, roman(number))
        .when(style == LOWER_ROMAN, roman(number, False))
        .when(style == UPPER_LETTER, alphabetic(number))
        .when(style == LOWER_LETTER, alphabetic(number, False))
        .when(style == BULLET, F.lit("•"))
        .otherwise(number.cast("string"))
    )


def resolve_levels(items: DataFrame, levels: DataFrame, overrides: DataFrame, by: str = "doc_id") -> DataFrame:
    """Definition of each item's list level: the level is clamped to the list's last; an override of the level itself wins, first
    by a whole level, then by its start."""
    last = levels.groupBy(by, "list_id").agg(F.max("level").alias("__last"))
    base = items.join(last, [by, "list_id"], "left").withColumn("__k", F.least("level", "__last"))
    lv = levels.select(by, "list_id", F.col("level").alias("__k"), "number_style", "number_format", "start_at")
    ov = overrides.select(by, "list_id", F.col("ilvl").alias("level"), F.col("start_at").alias("__start"), F.col("level_override").alias("__o"))
    joined = base.join(lv, [by, "list_id", "__k"], "left").join(ov, [by, "list_id", "level"], "left")
    for c in ("number_style", "number_format"):
        joined = joined.withColumn(c, F.coalesce(F.col(f"__o.{c}"), F.col(c)))
    return joined.withColumn("start_at", F.coalesce(F.col("__o.start_at"), F.col("__start"), F.col("start_at"))).drop("__last", "__k", "__start", "__o")


def overlapping(left: DataFrame, right: DataFrame, by: str = "doc_id", width: int = 4096) -> DataFrame:
    """Pairs of half-open intervals [cp_start, cp_end) of one document that overlap.

    Intervals are dealt to bins of a width, which makes the join an equi-join; a pair counts in the bin where the later one starts.
    """
    def bins(df: DataFrame, side: str) -> DataFrame:
        df = df.where("cp_end > cp_start").withColumnsRenamed({"cp_start": f"{side}_start", "cp_end": f"{side}_end"})
        return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{side}_start") / width), F.floor((F.col(f"{side}_end") - 1) / width))))

    pairs = bins(left, "l").join(bins(right, "r"), [by, "bin"])
    hit = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    return pairs.where(hit & (F.col("bin") == F.floor(F.greatest("l_start", "r_start") / width))).drop("bin")


def joined_blocks(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """Markdown of each document from its blocks (ord, tag, level, text).

    No blank line stands beside headings, between the items of a list, between rules, or before a quote of a higher level; a
    quote of no higher level is parted from one before it by a quoted blank line of the lesser level, and all else by a blank
    line, a setext heading (tag setext) too unless it follows a heading.
    """
    w = W.partitionBy(by).orderBy("ord")
    tag, prev = F.col("tag"), F.lag("tag").over(w)
    sep = (
        F.when(prev.isNull(), "")
        .when((tag == "setext") & ~prev.isin("heading", "setext"), "\n\n")
        .when(tag.isin("heading", "setext") | prev.isin("heading", "setext") | ((tag == "rule") & (prev == "rule")), "\n")
        .when((tag == "item") & (prev == "item"), "\n")
        .when((tag == "quote") & (prev == "quote") & (F.col("level") > F.lag("level").over(w)), "\n")
        .when((tag == "quote") & (prev == "quote"), F.concat(F.lit("\n"), F.repeat(F.lit(">"), F.least(F.col("level"), F.lag("level").over(w))), F.lit("\n")))
        .otherwise("\n\n")
    )
    text = ordered_text(blocks.withColumn("text", F.concat(sep, F.col("text"))), [by], "ord", "text", "")
    return text.withColumn("text", F.concat(F.regexp_replace("text", r"\s+\z", ""), F.lit("\n")))


def link_references(links: DataFrame, by: str = "doc_id", every: bool = False) -> DataFrame:
    """Numbers of link destinations for reference links: in order of first use, those used more than once (or every one)."""
    key = F.regexp_replace(F.regexp_replace("destination", r"^<|>$", ""), r"\\", "")
    used = links.withColumn("key", key).groupBy(by, "key").agg(F.count("*").alias("uses"), F.min("ord").alias("first"))
    used = used if every else used.where("uses > 1")
    return used.withColumn("number", F.row_number().over(W.partitionBy(by).orderBy("first", "key")))


def pipe_tables(cells: DataFrame, by: list[str]) -> DataFrame:
    """Pipe tables from cells (row_idx, col_idx, text, alignment of row 0): columns at least three wide, ragged rows padded."""
    clean = cells.withColumn("text", F.trim(F.regexp_replace(F.replace("text", F.lit("|"), F.lit(r"\|")), r"[\r\n]+", " ")))
    width = clean.groupBy(*by, "col_idx").agg(F.greatest(F.lit(3), F.max(F.length("text"))).alias("width"), F.max(F.when(F.col("row_idx") == 0, F.col("alignment"))).alias("align"))
    rows = clean.select(*by, "row_idx").distinct()
    grid = rows.join(width, by).join(clean.select(*by, "row_idx", "col_idx", "text"), [*by, "row_idx", "col_idx"], "left")
    grid = grid.withColumn("cell", F.rpad(F.coalesce("text", F.lit("")), F.greatest("width", F.length(F.coalesce("text", F.lit("")))), " "))
    line = lambda c: F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", c))), lambda p: p["x"]), " | "), F.lit(" |"))
    lines = grid.groupBy(*by, "row_idx").agg(line(F.col("cell").alias("x")).alias("text"))
    dash = F.when(F.col("align") == 1, F.concat(F.lit(":"), F.repeat(F.lit("-"), F.col("width") - 2), F.lit(":"))).when(F.col("align") == 2, F.concat(F.repeat(F.lit("-"), F.col("width") - 1), F.lit(":"))).otherwise(F.repeat(F.lit("-"), F.col("width")))
    marks = width.groupBy(*by).agg(line(dash.alias("x")).alias("text")).withColumn("row_idx", F.lit(0.5))
    return ordered_text(lines.withColumn("row_idx", F.col("row_idx").cast("double")).unionByName(marks), by, "row_idx", "text")


def html_tables(cells: DataFrame, by: list[str]) -> DataFrame:
    """HTML tables from cells; row 0 is the head."""
    text = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    tag = F.when(F.col("row_idx") == 0, "th").otherwise("td")
    cell = cells.withColumn("text", F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">")))
    rows = ordered_text(cell, [*by, "row_idx"], "col_idx", "text", "").withColumn("text", F.concat(F.lit("<tr>"), "text", F.lit("</tr>")))
    return ordered_text(rows, by, "row_idx", "text", "").withColumn("text", F.concat(F.lit("<table>"), "text", F.lit("</table>")))


def interned_images(images: DataFrame, by: str = "doc_id") -> DataFrame:
    """Part names of images: equal bytes of a document share one, numbered in order of first use."""
    keyed = images.withColumn("digest", F.sha2("content", 256))
    first = keyed.groupBy(by, "digest").agg(F.min("ord").alias("first"))
    named = first.withColumn("number", F.row_number().over(W.partitionBy(by).orderBy("first")))
    return keyed.join(named.drop("first"), [by, "digest"])
