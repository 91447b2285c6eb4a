"""Block structure of Markdown from rows of lines, by windows and pointers instead of a walk through each text.

For every line it is told what block would begin there and where that block would end: an end is the next line of some property,
which a running value from below gives for all lines at once. Which beginnings are real is found from each text's first line on,
where the end of a block is the next beginning, by doubling. What stands inside quotes, items and footnotes is then taken as
texts of their own, all of one depth in one round, until no container is left.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.relational import ordered_text
from foliant.operators.running import HOT_ROWS, Scan, cut, dealt, reached, running

# The line patterns of the grammar.
FENCE = r"^( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$"
CLOSE = r"^ {0,3}(`{3,}|~{3,})[ \t]*$"
ATX = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
RULE = r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"
SETEXT = r"^ {0,3}(=+|-+)[ \t]*$"
QUOTE = r"^ {0,3}>[ ]?"
ITEM = r"^( {0,3})([-+*]|[0-9]{1,9}[.)])([ \t]+|$)"
DELIMITERS = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
DEFINITION = r"\A {0,3}\[(?!\^)((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]*\n?[ \t]+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*\z"
FOOTNOTE = r"^ {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$"
HTML = r"(?i)^ {0,3}</?(?:address|article|aside|blockquote|center|div|dl|dt|dd|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?:[\s/>]|$)"
#: Lines that a reference definition may span.
DEFINITION_LINES = 8
CONTAINERS = ("quote", "item", "footnote")


def _blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _lead(c: Column) -> Column:
    return F.regexp_extract(c, r"^[ \t]*", 0)


def indent(line: Column) -> Column:
    """Columns of leading blanks; a tab is four."""
    lead = _lead(line)
    return F.length(lead) + 3 * F.length(F.regexp_replace(lead, " ", ""))


def cut_columns(line: Column, n: Column) -> Column:
    """The line without up to n columns of leading blanks; what is left of a tab stays as blanks."""
    zero = F.struct(n.cast("int").alias("n"), F.lit(0).alias("taken"))
    width = lambda c: F.when(c == "\t", 4).otherwise(1)
    step = lambda a, c: F.when(a["n"] > 0, F.struct((a["n"] - width(c)).alias("n"), (a["taken"] + 1).alias("taken"))).otherwise(a)
    tabs = F.aggregate(F.filter(F.split(_lead(line), ""), lambda c: c != ""), zero, step, lambda a: F.concat(F.repeat(F.lit(" "), F.greatest(-a["n"], F.lit(0))), F.substring(line, a["taken"] + 1, F.length(line))))
    plain = F.substring(line, F.least(n, F.length(_lead(line))) + 1, F.length(line))
    return F.when(_lead(line).contains("\t"), tabs).otherwise(plain)


def cells_of(line: Column) -> Column:
    """Cells of a table row; an escaped bar parts none."""
    s = F.regexp_replace(_strip(line), r"^\|", "")
    s = F.when(s.endswith("|") & ~s.endswith("\\|"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    return F.transform(F.split(s, r"(?<!\\)\|", -1), lambda c: _strip(F.replace(c, F.lit("\\|"), F.lit("|"))))


def _marked(lines: DataFrame, by: list[str], hot_rows: float) -> DataFrame:
    """Lines with what each would begin, the flags that end other blocks, and the parts of its markers."""
    down = running(lines.withColumn("neg", -F.col("ord")), by, ["neg"], {"following": Scan("last", F.col("text"), True)}, hot_rows)
    line, following = F.col("text"), F.coalesce(F.col("following"), F.lit(""))
    m = F.regexp_extract
    rows = down.withColumn("blank", _blank(line)).withColumn("indent", indent(line)).withColumn("is_fence", line.rlike(FENCE)).withColumn("is_quote", line.rlike(QUOTE)).withColumn("is_item", line.rlike(ITEM) & ~line.rlike(RULE))
    table = line.contains("|") & following.contains("|") & (F.col("indent") < 4) & following.rlike(DELIMITERS)
    rows = rows.withColumn("is_table", F.when(table, F.size(cells_of(line)) == F.size(cells_of(following))).otherwise(False))
    rest = F.substring(line, F.length(m(line, ITEM, 0)) + 1, F.length(line))
    marker = m(line, ITEM, 2)
    plain_item = line.rlike(ITEM) & ~_blank(rest) & (~marker.rlike("^[0-9]") | marker.rlike(r"^1[.)]$"))
    opens = F.col("blank") | F.col("is_fence") | line.rlike(ATX) | line.rlike(RULE) | F.col("is_quote") | line.rlike(HTML) | line.rlike(FOOTNOTE) | plain_item
    rows = rows.withColumn("opens", opens).withColumn("rest", F.when(line.rlike(ITEM), rest).when(line.rlike(FOOTNOTE), m(line, FOOTNOTE, 2)))
    gap = indent(m(line, ITEM, 3))
    width = F.length(m(line, ITEM, 1)) + F.length(marker) + F.when((gap >= 1) & (gap <= 4) & ~_blank(rest), gap).otherwise(1)
    kind = (
        F.when(F.col("blank"), "blank").when(F.col("is_fence"), "fence").when(line.rlike(ATX), "heading").when(line.rlike(RULE), "rule").when(F.col("is_table"), "table").when(F.col("is_quote"), "quote")
        .when(line.rlike(FOOTNOTE), "footnote").when(line.rlike(r"^ {0,3}\[(?!\^)"), "definition").when(line.rlike(ITEM), "item").when(F.col("indent") >= 4, "code").when(line.rlike(HTML), "html").otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind).withColumn("width", F.when(F.col("kind") == "footnote", 4).when(F.col("kind") == "item", width)).withColumn("gap", gap)
    return rows.withColumn("fence", F.when(F.col("is_fence"), m(line, FENCE, 2))).withColumn("close", F.when(line.rlike(CLOSE), m(line, CLOSE, 1)))


def _definitions(rows: DataFrame, by: list[str], hot_rows: float) -> DataFrame:
    """How many lines a reference definition takes that begins at a line; 0 for none."""
    some = running(rows, by, ["ord"], {"n": Scan("sum", F.lit(1))}, hot_rows)
    begin = F.col("kind") == "definition"
    near = running(some, by, ["ord"], {"since": Scan("last", F.when(begin, F.col("n")))}, hot_rows).where(F.col("n") - F.col("since") < DEFINITION_LINES)
    # each beginning with the lines after it, as far as they may reach
    starts = some.where(begin).select(*[F.col(b).alias(f"__{k}") for k, b in enumerate(by)], F.col("n").alias("at"))
    same = functools.reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"__{k}")) for k, b in enumerate(by)])
    met = near.join(starts, same & (F.col("n") >= F.col("at")) & (F.col("n") < F.col("at") + DEFINITION_LINES)).select(*by, "at", F.col("n").alias("o"), F.col("text").alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda p: p["t"])
    upto = lambda k: F.array_join(F.slice(texts, 1, k), "\n").rlike(DEFINITION) & (F.size(texts) >= k)
    lines = F.coalesce(*[F.when(upto(k), F.lit(k)) for k in range(DEFINITION_LINES, 0, -1)], F.lit(0))
    found = met.groupBy(*by, "at").agg(lines.alias("taken")).select(*[F.col(b).alias(f"__{k}") for k, b in enumerate(by)], "at", "taken")
    return some.join(found, same & (F.col("n") == F.col("at")), "left").drop(*[f"__{k}" for k in range(len(by))], "at")


def _ends(rows: DataFrame, by: list[str], hot_rows: float) -> DataFrame:
    """The number of the line after each block that could begin at a line (n counts a text's lines from 1); those of tables and paragraphs follow."""
    at = F.col("n")
    rows = running(rows, by, ["ord"], {"was": Scan("last", F.struct(F.col("blank").alias("blank"), F.col("is_quote").alias("quote"), F.col("text").alias("text"), F.col("indent").alias("indent")), True)}, hot_rows)
    before = F.col("was")
    said = F.when(before["quote"], ~_blank(F.regexp_replace(before["text"], QUOTE, ""))).otherwise(~before["blank"])
    lazy_quote = ~F.col("opens") & (F.col("indent") < 4) & F.coalesce(said, F.lit(False))
    fence_before = F.regexp_replace(before["text"], r"^[ \t]+", "").rlike(FENCE)
    lazy = ~F.col("opens") & ~F.col("text").rlike(ITEM) & F.coalesce(~before["blank"], F.lit(False))
    found = rows.agg(F.collect_set("width").alias("w"), F.collect_set(F.struct(F.substring("fence", 1, 1).alias("c"), F.length("fence").alias("n"))).alias("f")).head()
    widths, fences = sorted(found.w), sorted((x.c, x.n) for x in found.f if x.c)
    scans = {
        "no_row": F.col("blank") | ~F.col("text").contains("|"), "no_quote": ~F.col("is_quote") & ~lazy_quote, "no_code": ~F.col("blank") & (F.col("indent") < 4), "blank_line": F.col("blank"),
        "stop": F.col("text").rlike(SETEXT) | F.col("opens") | F.col("is_table"),
    }
    for w in widths:
        inside_fence = fence_before & (before["indent"] - w <= 3)
        scans[f"out{w}"] = ~F.col("blank") & (F.col("indent") < w) & ~(lazy & ~F.coalesce(inside_fence, F.lit(False)))
    for k, (c, n) in enumerate(fences):
        scans[f"fence{k}"] = F.coalesce((F.substring("close", 1, 1) == c) & (F.length("close") >= n), F.lit(False))
    rows = running(rows.withColumn("neg", -F.col("ord")), by, ["neg"], {s: Scan("last", F.when(p, at), True) for s, p in scans.items()} | {"last_line": Scan("sum", F.lit(1))}, hot_rows)
    rows = rows.withColumn("total", at + F.col("last_line") - 1)
    after = F.col("total") + 1
    # an item's next line is judged by what the item itself says: a bare marker, or a fence, has no lazy line after it
    rows = running(rows, by, ["ord"], {"said_before": Scan("last", F.when(~F.col("blank"), at), True)}, hot_rows)
    follow = running(rows.withColumn("neg", -F.col("ord")), by, ["neg"], {"below": Scan("last", F.struct("blank", "indent", "n", "opens", F.col("text").rlike(ITEM).alias("item")), True)}, hot_rows)
    end = F.when(F.col("kind").isin("blank", "heading", "rule"), at + 1)
    fence_ends = [F.when((F.substring("fence", 1, 1) == c) & (F.length("fence") == n), F.coalesce(F.col(f"fence{k}") + 1, after)) for k, (c, n) in enumerate(fences)]
    end = end.when(F.col("kind") == "fence", F.coalesce(*fence_ends, after))
    end = end.when(F.col("kind") == "quote", F.coalesce("no_quote", after)).when(F.col("kind") == "code", F.coalesce("no_code", after)).when(F.col("kind") == "html", F.coalesce("blank_line", after))
    out = F.coalesce(*[F.when(F.col("width") == w, F.coalesce(F.col(f"out{w}"), after)) for w in widths], after)
    bare = _blank(F.coalesce(F.col("rest"), F.lit(""))) | F.col("rest").rlike(FENCE)
    next_out = F.coalesce(~F.col("below.blank") & (F.col("below.indent") < F.col("width")) & (bare | F.col("below.opens") | F.col("below.item")), F.lit(False))
    # what the scan says of the very next line rests on the marker's line as it stands, so that line is judged here
    next_in = F.coalesce(~F.col("below.blank") & ~next_out, F.lit(False))
    follow = follow.withColumn("out", F.when(next_out, at + 1).otherwise(out)).withColumn("skips", next_in & (out == at + 1))
    end = F.when(F.col("kind").isin("item", "footnote"), F.col("out")).when(F.col("kind") == "definition", F.when(F.col("taken") > 0, at + F.col("taken"))).otherwise(end)
    return follow.withColumn("end", end)


def _resolved(rows: DataFrame, by: list[str], hot_rows: float) -> DataFrame:
    """Ends that depend on another line's: of tables, items whose next line is lazy, trailing blanks, paragraphs and what is one after all."""
    at, after = F.col("n"), F.col("total") + 1
    # one and two lines further down, what ends rows and containers there
    ahead = {"row2": Scan("last", F.struct("n", "no_row", "blank", "text"), True)}
    rows = running(rows.withColumn("neg", -F.col("ord")), by, ["neg"], ahead, hot_rows)
    widths = sorted(int(c[3:]) for c in rows.columns if c.startswith("out") and c[3:].isdigit())
    at_next = running(rows, by, ["neg"], {f"far{w}": Scan("last", F.struct(F.col(f"out{w}").alias("v")), True) for w in widths}, hot_rows) if widths else rows
    far = F.coalesce(*[F.when(F.col("width") == w, F.coalesce(F.col(f"far{w}.v"), after)) for w in widths], after)
    rows = at_next.withColumn("end", F.when(F.col("kind").isin("item", "footnote") & F.col("skips"), far).otherwise(F.col("end")))
    # a table's rows begin two lines below: the delimiters' line has a bar, so the first line without one is the end
    rows = rows.withColumn("end", F.when(F.col("kind") == "table", F.coalesce("row2.no_row", after)).otherwise(F.col("end")))
    kind = F.when((F.col("kind") == "definition") & F.col("end").isNull(), F.when(F.col("indent") >= 4, "code").otherwise("paragraph")).otherwise(F.col("kind"))
    rows = rows.withColumn("kind", kind)
    stop = F.coalesce("stop", after)
    named = rows.select(*[F.col(b).alias(f"__{k}") for k, b in enumerate(by)], F.col("n").alias("__n"), F.col("text").rlike(SETEXT).alias("under"), F.col("said_before").alias("__said"))
    same = functools.reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"__{k}")) for k, b in enumerate(by)])
    look = F.when(F.col("kind") == "paragraph", stop).when(F.col("kind").isin("item", "footnote"), F.col("end"))
    met = rows.withColumn("look", look).join(named, same & (F.col("look") == F.col("__n")), "left").drop(*[f"__{k}" for k in range(len(by))], "__n")
    tail = running(met, by, ["ord"], {"full": Scan("last", F.when(~F.col("blank"), at))}, hot_rows)
    ends_at = tail.groupBy(*by).agg(F.max(F.when(~F.col("blank"), at)).alias("last_full"))
    tail = tail.join(ends_at.select(*[F.col(b).alias(f"__{k}") for k, b in enumerate(by)], "last_full"), same).drop(*[f"__{k}" for k in range(len(by))])
    # an item ends after its last line that isn't blank
    full = F.when(F.col("look") <= F.col("total"), F.col("__said")).otherwise(F.col("last_full"))
    end = F.when(F.col("kind") == "paragraph", F.when(F.coalesce("under", F.lit(False)), stop + 1).otherwise(stop)).when(F.col("kind").isin("item", "footnote"), F.greatest(full, at) + 1).otherwise(F.col("end"))
    return tail.withColumn("end", end).withColumn("kind", F.when((F.col("kind") == "paragraph") & F.coalesce("under", F.lit(False)), "setext").otherwise(F.col("kind")))


def markdown_blocks(lines: DataFrame, by: str = "doc_id", hot_rows: float = HOT_ROWS) -> DataFrame:
    """(by, path, kind, text, level, info) of all blocks of texts given by lines (by, ord, text).

    A block's path are its number in its text and those of its containers before it. Kinds: fence, heading, setext, rule, table,
    code, html, paragraph, definition; quote, item and footnote hold blocks. Blank lines are no blocks; a container without any
    has one empty paragraph. Rows without a document take no part. text: of a leaf its lines as they count; of a table its rows, a line each, cells parted by tabs.
    level: of headings, of fences 1 for tildes, of items 1 if ordered; info: of fences what follows, of items the
    marker's last character, of footnotes the label. Null text is a blank line.
    """
    keys = [by, "path"]
    todo = lines.where(F.col(by).isNotNull()).select(by, F.array().cast("array<int>").alias("path"), F.col("ord").cast("long").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    todo, made = cut(todo), None
    while (size := todo.groupBy(*keys).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).head()).most is not None:
        small = size.most <= hot_rows
        hot_rows = math.inf if small else hot_rows  # texts only get shorter
        rows = _definitions(_marked(dealt(todo, keys, size.all) if small else todo, keys, hot_rows), keys, hot_rows)
        rows = cut(_resolved(cut(_ends(rows, keys, hot_rows)), keys, hot_rows).select(*keys, "ord", "n", "text", "kind", "end", "width", "gap", "rest", "fence", "blank", "indent", "is_quote"))
        begins = reached(rows.select(*keys, F.col("n").alias("i"), F.col("end").cast("long").alias("to")), keys)
        starts = rows.join(begins.withColumn("begins", F.lit(True)).withColumnRenamed("i", "n"), [*keys, "n"], "left")
        numbered = running(starts, keys, ["ord"], {"block": Scan("sum", F.when(F.col("begins") & (F.col("kind") != "blank"), 1)), "head": Scan("last", F.when(F.col("begins"), F.struct("n", "kind", "width", "gap", "rest", "fence", "text", "indent")))}, hot_rows)
        numbered = cut(numbered.where("head.kind <> 'blank'").withColumn("place", F.concat("path", F.array((F.col("block") - 1).cast("int")))))
        made = _leaves(numbered, by) if made is None else made.unionByName(_leaves(numbered, by))
        inner = numbered.where(F.col("head.kind").isin(*CONTAINERS))
        first = F.col("n") == F.col("head.n")
        pad = F.when((F.col("head.kind") == "item") & (F.col("head.gap") > 4), F.repeat(F.lit(" "), F.col("head.gap") - 1)).otherwise("")
        taken = F.when(F.col("head.kind") == "quote", F.regexp_replace("text", QUOTE, "")).when(first, F.concat(pad, F.col("head.rest"))).when(F.col("blank"), "").when(F.col("indent") >= F.col("head.width"), cut_columns(F.col("text"), F.col("head.width"))).otherwise(F.regexp_replace("text", r"(?U)^\s+", ""))
        todo = cut(inner.select(by, F.col("place").alias("path"), "ord", taken.alias("text")))
    if made is None:
        return lines.sparkSession.createDataFrame([], f"{by} {lines.schema[by].dataType.simpleString()}, path array<int>, kind string, text string, level int, info string")
    filled = made.where("kind <> 'definition'").where(F.size("path") > 1).select(by, F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
    empty = made.where(F.col("kind").isin("quote", "item")).join(filled, [by, "path"], "left_anti")
    return made.unionByName(empty.select(by, F.concat("path", F.array(F.lit(0))).alias("path"), F.lit("paragraph").alias("kind"), F.lit("").alias("text"), F.lit(0).alias("level"), F.lit("").alias("info")))


def _leaves(rows: DataFrame, by: str) -> DataFrame:
    """One row for each block from its lines."""
    kind, head, first = F.col("head.kind"), F.col("head.text"), F.col("n") == F.col("head.n")
    tail = F.max("n").over(W.partitionBy(by, "place"))
    rows = rows.withColumn("final", F.col("n") == tail)
    fence = F.col("head.fence")
    closing = F.col("final") & ~first & (F.substring(F.regexp_extract("text", CLOSE, 1), 1, 1) == F.substring(fence, 1, 1)) & (F.length(F.regexp_extract("text", CLOSE, 1)) >= F.length(fence))
    text = (
        F.when(kind == "fence", F.when(~first & ~closing, cut_columns(F.col("text"), F.length(F.regexp_extract(head, FENCE, 1)))))
        .when(kind == "heading", F.when(_strip(F.regexp_extract(head, ATX, 2)).rlike("^#+$"), "").otherwise(_strip(F.regexp_extract(head, ATX, 2))))
        .when(kind == "setext", F.when(~F.col("final"), _strip(F.col("text"))))
        .when(kind == "table", F.when(F.col("n") != F.col("head.n") + 1, F.array_join(cells_of(F.col("text")), "\t")))
        .when(kind == "code", cut_columns(F.col("text"), F.lit(4)))
        .when(kind == "html", F.col("text"))
        .when(kind == "paragraph", F.regexp_replace("text", r"(?U)^\s+", ""))
    )
    level = (
        F.when(kind == "fence", (F.substring(fence, 1, 1) == "~").cast("int")).when(kind == "heading", F.length(F.regexp_extract(head, ATX, 1)))
        .when(kind == "item", F.regexp_extract(head, ITEM, 2).rlike("^[0-9]").cast("int")).when(kind == "setext", F.max(F.when(F.col("final"), F.when(F.col("text").contains("="), 1).otherwise(2))).over(W.partitionBy(by, "place"))).otherwise(0)
    )
    info = F.when(kind == "fence", F.regexp_extract(head, FENCE, 3)).when(kind == "item", F.right(F.regexp_extract(head, ITEM, 2), F.lit(1))).when(kind == "footnote", F.regexp_extract(head, FOOTNOTE, 1)).otherwise("")
    parts = rows.select(by, F.col("place").alias("path"), kind.alias("kind"), "ord", text.alias("text"), level.alias("level"), info.alias("info"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text")))), lambda p: p["text"]), "\n")
    out = parts.groupBy(by, "path", "kind").agg(joined.alias("text"), F.max("level").cast("int").alias("level"), F.max("info").alias("info"))
    return out.withColumn("text", F.when(F.col("kind") == "paragraph", F.regexp_replace("text", r"(?U)\s+\z", "")).when(F.col("kind") == "code", F.regexp_replace("text", r"(?U)(\n\s*)+\z", "")).otherwise(F.col("text")))
