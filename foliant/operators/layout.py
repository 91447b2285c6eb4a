"""Layout of blocks and tables: column widths, row heights, balanced columns, pages, and which border an edge shows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.running import HOT_ROWS, Scan, cut, dealt, nearest_before, reached, running

# A row's least height, a line's height and a cell's paddings in a table, in millimetres.
LEAST_ROW, LINE, PAD_TOP, PAD_LEFT = 11 * 0.5, 11 * 0.42, 0.5, 1.0
#: Part of a line that text may be too long by: sums of widths aren't exact.
SLACK = 1e-6
#: Columns that a section can have.
MOST_COLUMNS = 45
#: Blocks of a key whose pages are found in one array.
FOLD_ROWS = 4096


def column_widths(cells: DataFrame, by: list[str], usable: float) -> DataFrame:
    """(by, col_idx, width) of each table's columns within the usable width.

    cells have row_idx, col_idx and width (null or below 0: none is stated). A column is as wide as its widest cell; columns
    that state no width share what is left, if anything is; wider tables are scaled down. Where nothing is stated all columns
    are equal. A table has all columns up to the last that occurs.
    """
    stated = cells.groupBy(*by, "col_idx").agg(F.greatest(F.coalesce(F.max("width"), F.lit(0.0)), F.lit(0.0)).cast("double").alias("w"))
    table = stated.groupBy(*by).agg((F.max("col_idx") + 1).alias("n"), F.sum("w").alias("sum"), F.count_if(F.col("w") > 0).alias("some"))
    fill = F.when(F.col("some") == 0, usable / F.col("n")).when(F.col("sum") < usable, (usable - F.col("sum")) / (F.col("n") - F.col("some"))).otherwise(0.0)
    table = table.withColumn("fill", F.when(F.col("some") == F.col("n"), 0.0).otherwise(fill))
    whole = F.col("sum") + F.col("fill") * (F.col("n") - F.col("some"))
    table = table.withColumn("scale", F.when(whole > usable, usable / whole).otherwise(1.0))
    every = table.select(*by, "fill", "scale", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("col_idx"))
    met = every.join(stated.select(*by, F.col("col_idx").cast("int").alias("col_idx"), "w"), [*by, "col_idx"], "left")
    return met.select(*by, "col_idx", (F.when(F.coalesce(F.col("w"), F.lit(0.0)) > 0, F.col("w")).otherwise(F.col("fill")) * F.col("scale")).alias("width"))


def row_heights(cells: DataFrame, widths: DataFrame, by: list[str]) -> DataFrame:
    """(by, row_idx, height): what the tallest cell of each row needs, and no less than the row's stated height.

    cells have row_idx, col_idx, text_width (of the text on one line), row_height (null: none), wrap (null: true) and vertical
    (null: false). Wrapped text takes as many lines as its width asks for in its column; a column no wider than its paddings
    counts for nothing.
    """
    met = cells.join(widths, [*by, "col_idx"], "left")
    inner = F.col("width") - 2 * PAD_LEFT
    text = F.coalesce(F.col("text_width"), F.lit(0.0))
    need = (
        F.when(F.coalesce("vertical", F.lit(False)), text + 2 * PAD_TOP)
        .when(~F.coalesce("wrap", F.lit(True)), F.lit(LINE + 2 * PAD_TOP))
        .when(inner > 1, F.greatest(F.ceil(text / inner - SLACK), F.lit(1)) * LINE + 2 * PAD_TOP)
    )
    return met.groupBy(*by, "row_idx").agg(F.greatest(F.lit(LEAST_ROW), F.max(need), F.max("row_height")).alias("height"))


def balanced_columns(blocks: DataFrame, by: list[str], order: str, start: float, top: float, bottom: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """blocks with column_idx, the column of their section (by) that they stand in.

    blocks have height (null: 0) and columns, the number of their section's columns, MOST_COLUMNS at most. The first column begins
    at `start`, others at `top`; each column but the last should end where the section's whole height, divided by its columns,
    would (at `bottom` at most). A block goes to the next column if more than half of it would stand beyond that; a block that
    has gone on stays. Sections without height have one column.
    """
    rows = running(blocks.withColumn("__h", F.coalesce(F.col("height"), F.lit(0)).cast("double")), by, [order], {"__sum": Scan("sum", F.col("__h"), True)}, hot_rows)
    rows = cut(rows)
    plan = rows.groupBy(*by).agg(F.sum("__h").alias("__all"), F.least(F.max("columns"), F.lit(MOST_COLUMNS)).alias("__n"))
    plan = plan.withColumn("__target", F.least(start + F.col("__all") / F.col("__n"), F.lit(bottom))).where("__n > 1 and __all > 0")
    most = plan.agg(F.max("__n")).head()[0] or 1
    # where the column in work begins: the sum before its first block, and that block; the first column has none
    plan = cut(plan.withColumn("__base", F.lit(0.0)).withColumn("__y", F.lit(float(start))).withColumn("__from", F.lit(None).cast(rows.schema[order].dataType)))
    breaks = None
    keys = [F.col(b).alias(f"__key{k}") for k, b in enumerate(by)]
    same = [F.col(b).eqNullSafe(F.col(f"__key{k}")) for k, b in enumerate(by)]
    for column in range(1, most):
        named = plan.where(F.col("__n") > column).select(*keys, "__n", "__target", "__base", "__y", "__from")
        beyond = (F.col("__y") + F.col("__sum") - F.col("__base") + F.col("__h") / 2 > F.col("__target")) & (F.col("__from").isNull() | (F.col(order) > F.col("__from")))
        met = rows.join(named, same).where(beyond).groupBy(*by, "__n", "__target").agg(F.min(F.struct(F.col(order).alias("o"), F.col("__sum").alias("s"))).alias("b"))
        plan = cut(met.select(*by, "__n", "__target", F.col("b.s").alias("__base"), F.lit(float(top)).alias("__y"), F.col("b.o").alias("__from")))
        found = plan.select(*by, F.col("__from").alias(order), F.lit(1).alias("__break"))
        breaks = found if breaks is None else breaks.unionByName(found)
        if plan.isEmpty():
            break
    if breaks is None:
        return rows.select(*blocks.columns, F.lit(0).alias("column_idx"))
    breaks = breaks.select(*keys, F.col(order).alias("__at"), "__break")
    marked = rows.join(breaks, [*same, F.col(order) == F.col("__at")], "left")
    return running(marked, by, [order], {"column_idx": Scan("sum", F.col("__break"))}, hot_rows).select(*blocks.columns, F.col("column_idx").cast("int").alias("column_idx"))


def page_numbers(blocks: DataFrame, by: list[str], order: str, page_height: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """blocks with page, from 1: each page takes blocks in order as long as they fit; a block taller than a page has one of its own.

    blocks have height (null or below 0: 0). Keys of at most FOLD_ROWS blocks are walked as arrays. For larger ones, what page
    begins after a page that begins with some block is one look-up in the running heights, for all blocks at once; which of these
    beginnings are real is found from the first block on, by doubling.
    """
    h = F.greatest(F.coalesce(F.col("height"), F.lit(0)), F.lit(0)).cast("double")
    blocks, few = cut(blocks), min(FOLD_ROWS, hot_rows)
    sizes = blocks.groupBy(*by).count()
    most = sizes.agg(F.max("count")).head()[0] or 0
    if not re.search("map<|variant", blocks.schema.simpleString()):  # these can't be sorted along
        if most <= few:
            return _folded_pages(blocks, h, by, order, page_height)
        large = cut(sizes.where(F.col("count") > few).select(*[F.col(b).alias(f"__large{k}") for k, b in enumerate(by)]))
        same = [F.col(b).eqNullSafe(F.col(f"__large{k}")) for k, b in enumerate(by)]
        small = blocks.join(large, same, "left_anti")
        return _folded_pages(small, h, by, order, page_height).unionByName(_doubled_pages(blocks.join(large, same, "left_semi"), h, by, order, page_height, hot_rows))
    return _doubled_pages(blocks, h, by, order, page_height, hot_rows)


def _folded_pages(blocks: DataFrame, h: Column, by: list[str], order: str, page_height: float) -> DataFrame:
    """Pages of keys that each fit in an array, which is walked once; then it is cut where pages begin."""
    keys = [F.struct(F.col(b)).alias(f"__key{k}") for k, b in enumerate(by)]
    all_of = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), h.alias("h"), F.struct(*blocks.columns).alias("row"))))
    lists = blocks.groupBy(*keys).agg(all_of.alias("rows"))
    zero = F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("base"), F.lit(1).alias("i"), F.array().cast("array<int>").alias("begins"))

    def step(a: Column, x: Column) -> Column:
        end = a["before"] + x["h"]
        begins = (a["i"] == 1) | (end > a["base"] + F.lit(float(page_height)))
        on = lambda base, at: F.struct(end.alias("before"), base.alias("base"), (a["i"] + 1).alias("i"), at.alias("begins"))
        return F.when(begins, on(a["before"], F.concat(a["begins"], F.array(a["i"])))).otherwise(on(a["base"], a["begins"]))

    lists = lists.withColumn("begins", F.aggregate("rows", zero, step, lambda a: F.concat(a["begins"], F.array(a["i"]))))
    pages = lists.select("rows", "begins", F.explode(F.sequence(F.lit(1), F.size("begins") - 1)).alias("page"))
    begin, after = F.element_at("begins", F.col("page")), F.element_at("begins", F.col("page") + 1)
    shown = pages.select(F.col("page").cast("long").alias("page"), F.explode(F.slice("rows", begin, after - begin)).alias("r"))
    return shown.select(*[F.col("r.row")[c].alias(c) for c in blocks.columns], "page")


def _doubled_pages(blocks: DataFrame, h: Column, by: list[str], order: str, page_height: float, hot_rows: int) -> DataFrame:
    """Pages of keys of any size."""
    rows = cut(running(blocks.withColumn("__h", h), by, [order], {"__before": Scan("sum", F.col("__h"), True), "__i": Scan("sum", F.lit(1))}, hot_rows))
    names = [f"__key{k}" for k in range(len(by))]
    # keys as structs, which are equal where both hold null
    flat = rows.select(*[F.struct(F.col(b)).alias(n) for b, n in zip(by, names, strict=True)], F.col("__i").alias("i"), "__before", (F.col("__before") + F.col("__h")).alias("end"))
    fit = nearest_before(flat.select(*names, "i", (F.col("__before") + page_height).alias("place")), flat.select(*names, F.col("end").alias("place"), F.col("i").alias("last")), names, "place", ["last"], hot_rows)
    begins = reached(fit.select(*names, "i", F.greatest(F.col("i") + 1, F.coalesce(F.col("last"), F.lit(0)) + 1).alias("to")), names)
    found = begins.select(*[F.col(f"{n}.{b}").alias(f"__at_key{k}") for k, (n, b) in enumerate(zip(names, by, strict=True))], F.col("i").alias("__at"), F.lit(1).alias("__begins"))
    marked = rows.join(found, [*[F.col(b).eqNullSafe(F.col(f"__at_key{k}")) for k, b in enumerate(by)], F.col("__i") == F.col("__at")], "left")
    return running(marked, by, [order], {"page": Scan("sum", F.col("__begins"))}, hot_rows).select(*blocks.columns, "page")


SIDES = ("top", "bottom", "left", "right")  # in the order in which a cell draws them


def _side(side: str, outer: Column, layers: tuple[str, ...], visible) -> Column:
    """The cell's own border if it shows, else that of the first layer that has an entry for the side; an entry that doesn't show hides it."""
    inside = "inside_h" if side in ("top", "bottom") else "inside_v"
    entry = F.coalesce(*[F.when(outer, F.col(f"{layer}.{side}")).otherwise(F.col(f"{layer}.{inside}")) for layer in layers])
    return F.when(F.coalesce(visible(F.col(side)), F.lit(False)), F.col(side)).when(F.coalesce(visible(entry), F.lit(False)), entry)


def edge_borders(cells: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """(by, edge, line, place, border): the border of each edge of the grid that shows one.

    cells have row_idx, col_idx and a border (struct with line_style and line_width, or null) for each of SIDES; tables have
    own and style, each null or a struct of borders for SIDES, inside_h and inside_v. A border shows if it has a style or a width.
    A side shows the cell's own border, else the table's, else its style's, of which the first that has an entry counts, shown or
    not; edges between cells take the inside entries. Of two cells that meet at an edge the one
    drawn later shows: rows go down, cells to the right. Edge 'h' has the line above a row and the column as its place, 'v' the
    line left of a column and the row. A table that isn't in tables has no layers.
    """
    visible = lambda b: (F.coalesce(b["line_style"], F.lit(0)) != 0) | (F.coalesce(b["line_width"], F.lit(0.0)) > 0)
    cells = dealt(cells, by)
    size = cells.groupBy(*by).agg(F.max("row_idx").alias("__r"), F.max("col_idx").alias("__c"))
    met = cells.join(size, by).join(tables.select(*by, "own", "style"), by, "left")
    outer = {"top": F.col("row_idx") == 0, "bottom": F.col("row_idx") == F.col("__r"), "left": F.col("col_idx") == 0, "right": F.col("col_idx") == F.col("__c")}
    at = {"top": ("h", 0), "bottom": ("h", 1), "left": ("v", 0), "right": ("v", 1)}

    def drawn(k: int, side: str) -> Column:
        edge, on = at[side]
        line, place = (F.col("row_idx") + on, F.col("col_idx")) if edge == "h" else (F.col("col_idx") + on, F.col("row_idx"))
        return F.struct(F.lit(edge).alias("edge"), line.alias("line"), place.alias("place"), _side(side, outer[side], ("own", "style"), visible).alias("border"), F.lit(k).alias("k"))

    sides = met.select(*by, "row_idx", "col_idx", F.explode(F.array(*[drawn(k, s) for k, s in enumerate(SIDES)])).alias("s")).where("s.border is not null")
    return sides.groupBy(*by, F.col("s.edge").alias("edge"), F.col("s.line").alias("line"), F.col("s.place").alias("place")).agg(F.max_by("s.border", F.struct("row_idx", "col_idx", "s.k")).alias("border"))
