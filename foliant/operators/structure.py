"""Structure of documents over node tables: descendants, fields, merged cells, numbers of several levels, list groups, group boxes."""

from __future__ import annotations

import math
import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.relational import BULLET, list_label, ordered_text, overlapping
from foliant.operators.running import HOT_ROWS, Scan, along_ancestors, cut, dealt, gathered, running

# --- node trees

_AFTER = 2**31 - 1  # sorts after every place among children


def intervals(nodes: DataFrame, by: str = "doc_id", path: str = "path", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(by, path, type, pre, last): a node's number in document order and that of its last descendant; itself, if it has none.

    A node is known by its path, the places of its ancestors and its own among their children (array of int, not null); rows that
    repeat a path are one node, of the smallest type. Each node opens at its path and closes after all longer paths that begin
    with it; the opened ones so far are counted by one running sum, however deep the tree.
    """
    one = nodes.groupBy(by, path).agg(F.min("type").alias("type"))
    events = one.select(by, path, "type", F.col(path).alias("__at"), F.lit(1).alias("__open"))
    events = events.unionByName(one.select(by, path, "type", F.concat(path, F.array(F.lit(_AFTER))).alias("__at"), F.lit(0).alias("__open")))
    counted = running(events, [by], ["__at"], {"__n": Scan("sum", F.col("__open"))}, hot_rows)
    number = lambda k: F.max(F.when(F.col("__open") == k, F.col("__n")))
    return counted.groupBy(by, path).agg(F.first("type").alias("type"), number(1).alias("pre"), number(0).alias("last"))


def distinct_nodes(nodes: DataFrame, by: str = "doc_id", path: str = "path") -> DataFrame:
    """(by, path, type) of each node once, of the smallest type, held in the shared folder for all that is asked of the tree."""
    return cut(nodes.repartition(by, path).groupBy(by, path).agg(F.min("type").alias("type")))


#: Depths that origins may have for their descendants to be found by the beginnings of paths.
DEPTHS = 8
#: Places in all paths of a depth's origins that a broadcast may hold.
PLACES = 1_000_000


def child_nodes(nodes: DataFrame, origin_type: str, node_type: str | None = None, deep: bool = False, by: str = "doc_id", path: str = "path", hot_rows: int = HOT_ROWS, distinct: bool = False) -> DataFrame:
    """(by, origin, path, type): for each node of origin_type its children, or with `deep` all descendants; of node_type, or any.

    With `distinct`, nodes are known not to repeat a path (see distinct_nodes). Where origins lie at few depths, a descendant's
    path begins with its origin's: one join for each depth. Else descendants are found by the containment of intervals, without
    walking; nested origins each have theirs.
    """
    if deep:
        one = nodes.select(by, path, "type") if distinct else distinct_nodes(nodes, by, path)
        origins = one.where(F.col("type") == origin_type).select(by, F.col(path).alias("origin"))
        depths = origins.groupBy(F.size("origin").alias("depth")).count().limit(DEPTHS + 1).collect()
        if len(depths) <= DEPTHS:
            kids = one if node_type is None else one.where(F.col("type") == node_type)
            found = kids.where(F.lit(False)).select(by, F.col(path).alias("origin"), path, "type")
            for depth, n in depths:
                below = kids.where(F.size(path) > depth).withColumn("origin", F.slice(path, 1, depth))
                tops = origins.where(F.size("origin") == depth)
                # few origins may have most nodes below them: these aren't dealt by origin then
                tops = F.broadcast(tops) if n * (depth + 1) <= PLACES else tops
                found = found.unionByName(below.join(tops, [by, "origin"]).select(by, "origin", path, "type"))
            return found
        nodes = one
    if not deep:
        one = nodes.select(by, path, "type") if distinct else nodes.groupBy(by, path).agg(F.min("type").alias("type"))
        kids = one.where(F.size(path) > 0).withColumn("origin", F.slice(path, F.lit(1), F.size(path) - 1))
        kids = kids if node_type is None else kids.where(F.col("type") == node_type)
        return kids.join(one.where(F.col("type") == origin_type).select(by, F.col(path).alias("origin")), [by, "origin"], "left_semi").select(by, "origin", path, "type")
    marked = intervals(nodes, by, path, hot_rows)
    left = marked.where((F.col("type") == origin_type) & (F.col("last") > F.col("pre"))).select(by, F.col(path).alias("origin"), (F.col("pre") + 1).alias("cp_start"), (F.col("last") + 1).alias("cp_end"))
    right = marked if node_type is None else marked.where(F.col("type") == node_type)
    right = right.select(by, path, "type", F.col("pre").alias("cp_start"), (F.col("pre") + 1).alias("cp_end"))
    return overlapping(left, right, by).select(by, "origin", path, "type")


# --- fields

# The name of the field, and the forms of its arguments (switch, quoted, bare).
_FIELD, _ARGUMENT = "HYPERLINK", r'\\+[a-zA-Z]|"[^"]*"|\S+'
_MARKUP = ("(", ")", "<", ">")


def hyperlink_target(code: Column) -> Column:
    """struct(address, title) of a HYPERLINK field's code; both empty for any other field."""
    bare = F.regexp_replace(code, r"^\s+|\s+$", "")
    empty = F.struct(F.lit("").alias("pending"), F.lit("").alias("address"), F.lit("").alias("place"), F.lit("").alias("title"))

    def step(a: Column, token: Column) -> Column:
        switch = token.rlike(r"^\\+[a-zA-Z]$")
        quoted = (F.length(token) > 1) & token.startswith('"') & token.endswith('"')
        value = F.replace(F.when(quoted, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(token), F.lit("\\\\"), F.lit("\\"))
        place, title = a["pending"] == "l", a["pending"] == "o"
        taken = F.struct(
            F.lit("").alias("pending"), F.when(~place & ~title & (a["address"] == ""), value).otherwise(a["address"]).alias("address"),
            F.when(place, value).otherwise(a["place"]).alias("place"), F.when(title, value).otherwise(a["title"]).alias("title"),
        )
        return F.when(switch, F.struct(F.right(token, F.lit(1)).alias("pending"), a["address"], a["place"], a["title"])).otherwise(taken)

    def end(a: Column) -> Column:
        return F.struct(F.when(a["place"] != "", F.concat(a["address"], F.lit("#"), a["place"])).otherwise(a["address"]).alias("address"), a["title"].alias("title"))

    tokens = F.regexp_extract_all(F.substring(bare, F.lit(len(_FIELD) + 1), F.length(bare)), F.lit(_ARGUMENT), F.lit(0))
    return F.when(F.upper(bare).startswith(_FIELD), F.aggregate(tokens, empty, step, end)).otherwise(F.struct(F.lit("").alias("address"), F.lit("").alias("title")))


def link_destination(address: Column, title: Column) -> Column:
    """A link's destination and title in Markdown; with white space the destination stands in angle brackets."""
    plain, angled = address, F.replace(F.replace(address, F.lit("<"), F.lit("\\<")), F.lit(">"), F.lit("\\>"))
    for symbol in _MARKUP:
        plain = F.replace(plain, F.lit(symbol), F.lit("\\" + symbol))
    where = F.when(address.rlike(r"\s"), F.concat(F.lit("<"), angled, F.lit(">"))).otherwise(plain)
    said = F.replace(F.replace(title, F.lit('\\"'), F.lit('"')), F.lit('"'), F.lit('\\"'))
    return F.concat(where, F.when(title != "", F.concat(F.lit(' "'), said, F.lit('"'))).otherwise(""))


def folded_fields(inlines: DataFrame, by: list[str], order: str = "ord", kind: str = "kind", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(by, text): each paragraph with its HYPERLINK fields folded into Markdown links.

    Inlines are field_start, field_separator, field_end, or run with its text; other kinds show nothing. What stands between a
    field's start and its separator is its code, the rest its result; a field within a field belongs to the outer one's result,
    wherever it stands. A field without an address, or with an empty result, is just its result. Ends and separators outside
    fields count for nothing; a field that isn't closed shows nothing, nor does what follows its start. Null text is empty.

    Starts and ends are matched by depth: of rows at one depth the last start so far is the field they stand in.
    """
    rows = inlines.select(*by, order, F.col(kind).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, hot_rows = gathered(rows, by, hot_rows)
    start, stop, part, run = (F.col("kind") == k for k in ("field_start", "field_end", "field_separator", "run"))
    delta = F.when(start, 1).when(stop, -1).otherwise(0)
    rows = running(rows, by, [order], {"s": Scan("sum", delta)}, hot_rows)
    rows = running(rows, by, [order], {"least": Scan("min", F.col("s")), "least_before": Scan("min", F.col("s"), True)}, hot_rows)
    low = lambda c: F.least(F.lit(0), F.coalesce(F.col(c), F.lit(0)))
    rows = rows.withColumn("depth", F.col("s") - low("least")).withColumn("before", F.col("s") - delta - low("least_before"))
    rows = rows.withColumn("level", F.when(stop, F.col("before")).otherwise(F.col("depth")))
    rows = running(rows, [*by, "level"], [order], {"field": Scan("last", F.when(start, F.col(order))), "parted": Scan("last", F.when(part, F.col(order)))}, hot_rows)
    rows = rows.withColumn("field", F.when(F.col("level") > 0, F.col("field")))
    shown = run & (F.col("field").isNull() | F.coalesce(F.col("parted") > F.col("field"), F.lit(False)))
    # the first start that is never closed: the last one at the first level, if the paragraph ends within it
    opened, first = F.max_by("depth", order), F.max(F.when(start & (F.col("depth") == 1), F.col(order)))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    if hot_rows == math.inf:
        w = W.partitionBy(*by)
        rows = rows.withColumn("open", opened.over(w)).withColumn("first", first.over(w))
        rows = rows.withColumn("first", F.when(F.col("open") > 0, F.col("first"))).drop("open")
    else:
        whole = rows.groupBy(*by).agg(opened.alias("open"), first.alias("first"))
        whole = whole.where("open > 0").select(*[F.col(b).alias(f"__{b}") for b in by], "first")
        rows = rows.join(whole, same, "left").drop(*[f"__{b}" for b in by])
    rows = rows.withColumn("shown", shown & F.coalesce(F.col(order) < F.col("first"), F.lit(True)))
    rows = running(rows, by, [order], {"length": Scan("sum", F.when(F.col("shown"), F.length("text")).otherwise(0))}, hot_rows)
    rows = cut(rows)  # fields, their ends and the words all read them
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(run & ~F.col("shown"), F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))), lambda p: p["t"]), "")
    fields = rows.where("field is not null").groupBy(*by, "field").agg(code.alias("code"), F.max(F.when(stop, F.col("length"))).alias("upto"), F.max(F.when(start, F.col("length"))).alias("since"))
    links = fields.where("upto > since").withColumn("target", hyperlink_target(F.col("code"))).where("target.address <> ''")
    links = links.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("field").alias("__field"), link_destination(F.col("target.address"), F.col("target.title")).alias("to"))
    # only starts and ends look for their link
    edge = (start | stop) & F.col("field").isNotNull() & F.coalesce(F.col(order) < F.col("first"), F.lit(True))
    ends = rows.where(edge).join(links, same & (F.col("field") == F.col("__field"))).select(*by, order, F.when(start, F.lit("[")).otherwise(F.concat(F.lit("]("), "to", F.lit(")"))).alias("text"))
    words = rows.select(*by, order, F.when(F.col("shown"), F.col("text")).otherwise("").alias("text"))
    return ordered_text(words.unionByName(ends.select(*by, order, "text")), by, order, "text", "")


# --- tables


def cell_grid(cells: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(by, row_idx, col_idx, grid_col, row_span, col_span): each cell that is shown, where it begins in the table's grid and what it covers.

    cells have row_idx, col_idx (neither null; a repeated place is one cell), grid_span (null or below 1: 1) and v_merge, which is
    restart, continue or null. A cell that continues belongs to the merged cell above it, in the row before, at the same grid
    column; where there is none it stands for itself, and opens a merge as a restart does.
    """
    cells, hot_rows = gathered(cells, by, hot_rows)
    one = cells.groupBy(*by, "row_idx", "col_idx").agg(F.max(F.struct(F.greatest(F.coalesce("grid_span", F.lit(1)), F.lit(1)).alias("s"), F.col("v_merge").alias("m"))).alias("c"))
    one = one.select(*by, "row_idx", "col_idx", F.col("c.s").alias("col_span"), F.col("c.m").alias("merge"))
    placed = running(one, [*by, "row_idx"], ["col_idx"], {"grid_col": Scan("sum", F.col("col_span"), True)}, hot_rows)
    column = [*by, "grid_col"]
    above = running(placed, column, ["row_idx"], {"above": Scan("last", F.struct("row_idx", "merge"), True)}, hot_rows)
    goes_on = (F.col("merge") == "continue") & (F.col("above.row_idx") == F.col("row_idx") - 1) & F.col("above.merge").isNotNull()
    marked = above.withColumn("top", F.when(F.coalesce(goes_on, F.lit(False)), F.lit(None)).otherwise(F.struct("row_idx", "col_idx", "col_span")))
    marked = running(marked.drop("above"), column, ["row_idx"], {"anchor": Scan("last", F.col("top"))}, hot_rows)
    anchor = [F.col(f"anchor.{c}").alias(c) for c in ("row_idx", "col_idx", "col_span")]
    spans = marked.groupBy(*column, *anchor).agg(F.count("*").alias("row_span"))
    return spans.select(*by, "row_idx", "col_idx", "grid_col", "row_span", "col_span")


# --- lists

# Levels of a list, and number styles whose label is the format itself.
LEVELS = 9
_UNNUMBERED = (BULLET, 255)


def level_labels(items: DataFrame, lists: DataFrame, by: str = "doc_id", order: str = "ord", hot_rows: int = HOT_ROWS) -> DataFrame:
    """items (by, list_id, ord, level, ...) with their label: the format of their level, %1 to %9 replaced by the numbers of those levels.

    lists (by, list_id, levels) have for each level, from the first on, a struct (number_style, number_format, start_at). A level
    counts on from its start, 1 at least, until an item of a higher level comes between; a level that hasn't begun has the number
    0. A level beyond the list's last is the last. Bullets show their format and neither count nor end a count. An empty format is
    "%1."; items of lists that aren't defined, or have no levels, have no label.

    For each level two running sums give the number: its items so far, less those before the last item of a higher level.
    """
    known = lists.groupBy(by, "list_id").agg(F.first("levels").alias("__levels"))
    rows = dealt(items, [by]).join(known, [by, "list_id"], "left")
    rows = rows.withColumn("__k", F.least(F.col("level"), F.size("__levels") - 1))
    rows = rows.withColumn("__own", F.get("__levels", F.col("__k")))
    own_style = F.coalesce(F.col("__own.number_style"), F.lit(0))
    counts = F.col("__own").isNotNull() & ~own_style.isin(*_UNNUMBERED)
    at = F.when(counts, F.col("__k"))
    rows = running(rows.withColumn("__at", at), [by, "list_id"], [order], {f"__n{j}": Scan("sum", (F.col("__at") == j).cast("int")) for j in range(LEVELS)}, hot_rows)
    rows = running(rows, [by, "list_id"], [order], {f"__b{j}": Scan("last", F.when(F.col("__at") < j, F.col(f"__n{j}"))) for j in range(1, LEVELS)}, hot_rows)
    label = F.when(F.coalesce(F.col("__own.number_format"), F.lit("")) == "", "%1.").otherwise(F.col("__own.number_format"))
    for j in range(-1, LEVELS):
        level = F.get("__levels", F.lit(max(j, 0)))
        style = F.when(level.isNull(), own_style).otherwise(F.coalesce(level["number_style"], F.lit(0))) if j >= 0 else own_style
        n = F.col(f"__n{j}") - (F.coalesce(F.col(f"__b{j}"), F.lit(0)) if j else 0) if j >= 0 else F.lit(0)
        number = F.when(n > 0, n + F.greatest(F.coalesce(level["start_at"], F.lit(1)), F.lit(1)) - 1).otherwise(0)
        label = F.replace(label, F.lit(f"%{j + 1}"), F.when(style == BULLET, number.cast("string")).otherwise(list_label(number.cast("int"), style)))
    label = F.when(counts, label).otherwise(F.col("__own.number_format"))
    return rows.withColumn("label", F.when(F.col("__own").isNotNull(), label)).select(*items.columns, "label")


def list_groups(paragraphs: DataFrame, by: str = "doc_id", order: str = "ord", first: int = 1001, hot_rows: int = HOT_ROWS) -> DataFrame:
    """paragraphs with group_id: list items that follow each other and are of one kind share one, numbered from `first` in each document.

    paragraphs have list_ref (null or 0: no item), is_bullet and text; one that is blank or of a table (in_table) ends a group,
    as does one that is no item, and has none.
    """
    item = (F.coalesce(F.col("list_ref"), F.lit(0)) > 0) & ~F.coalesce(F.col("in_table"), F.lit(False)) & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    rows = paragraphs.withColumn("__item", item)
    kind = F.when(F.col("__item"), F.coalesce(F.col("is_bullet"), F.lit(False)).cast("int")).otherwise(-1)
    rows = running(rows.withColumn("__kind", kind), [by], [order], {"__prev": Scan("last", F.col("__kind"), True)}, hot_rows)
    begins = F.col("__item") & (F.coalesce(F.col("__prev"), F.lit(-1)) != F.col("__kind"))
    rows = running(rows.withColumn("__begins", begins.cast("int")), [by], [order], {"__group": Scan("sum", F.col("__begins"))}, hot_rows)
    return rows.select(*paragraphs.columns, F.when(F.col("__item"), F.col("__group") + first - 1).alias("group_id"))


# --- shapes


def group_boxes(groups: DataFrame, shapes: DataFrame, by: str = "doc_id", unit: float = 36_000.0) -> DataFrame:
    """shapes (by, shape_id, group_id, x, y, cx, cy) with left, top, width, height: their box on the page, in units of `unit`.

    groups (by, group_id, parent_id, x, y, ch_x, ch_y, sx, sy) scale what they hold by (sx, sy) from the place (ch_x, ch_y). An
    outermost group stands on the page; a group within another is moved on from it by its own place at the scale that the other
    group was itself given, that of the groups around it. Null numbers are 0, null scales 1; a parent that is no group is none.
    Shapes without a group are placed as they are; groups on a cycle, and all in them, have no box.

    Scales multiply and offsets add up along ancestors, both by pointer doubling.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    num = lambda c, d: F.coalesce(F.col(c).cast("double"), d)
    own = groups.select(by, "group_id", "parent_id", *[num(c, zero).alias(c) for c in ("x", "y", "ch_x", "ch_y")], *[num(c, one).alias(c) for c in ("sx", "sy")])
    scaled = along_ancestors(own, [by], "group_id", "parent_id", {f"scale_{a}": ("product", F.col(f"s{a}")) for a in "xy"})

    def of_parent(rows: DataFrame, columns: dict[str, str], found: str) -> DataFrame:
        upper = rows.select(by, F.col("group_id").alias("parent_id"), F.lit(True).alias(found), *[F.col(c).alias(n) for c, n in columns.items()])
        return rows.join(upper.dropDuplicates([by, "parent_id"]), [by, "parent_id"], "left")

    given = of_parent(scaled, {"scale_x": "__x", "scale_y": "__y"}, "__under")
    given = cut(given.select(*scaled.columns, *[F.when(F.col("__under"), F.col(f"__{a}")).otherwise(one).alias(f"given_{a}") for a in "xy"]))
    moved = of_parent(given, {"given_x": "__x", "given_y": "__y"}, "__under")
    steps = [(F.col(a) * F.when(F.col("__under"), F.col(f"__{a}")).otherwise(one) / unit).alias(f"step_{a}") for a in "xy"]
    moved = moved.select(by, "group_id", "parent_id", *steps, "ch_x", "ch_y", "scale_x", "scale_y")
    placed = along_ancestors(moved, [by], "group_id", "parent_id", {f"off_{a}": ("sum", F.col(f"step_{a}")) for a in "xy"})
    frame = placed.select(by, "group_id", F.lit(True).alias("__in"), *[c for a in "xy" for c in (f"off_{a}", f"ch_{a}", f"scale_{a}")])
    out = shapes.join(frame, [by, "group_id"], "left")
    place = lambda a: F.when(F.col("__in"), F.col(f"off_{a}") + (num(a, zero) - F.col(f"ch_{a}")) * F.col(f"scale_{a}") / unit).otherwise(num(a, zero) / unit)
    extent = lambda a: F.when(F.col("__in"), num(f"c{a}", zero) * F.col(f"scale_{a}") / unit).otherwise(num(f"c{a}", zero) / unit)
    return out.select(*shapes.columns, place("x").alias("left"), place("y").alias("top"), extent("x").alias("width"), extent("y").alias("height"))


# --- images

# The file endings of image types; any other gets that of PNG.
_ENDINGS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/svg+xml": ".svg", "image/tiff": ".tiff"}


def image_links(images: DataFrame, by: list[str], order: str = "ord", folder: str = "", alias: str = "", as_base64: bool = False, output_dir: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """images with markdown, the link that stands for each, and file, the path to write its bytes to (null: none).

    images have content (null or empty: linked), source (a file name or address), alt and content_type, null counting as empty.
    A linked image points at its source. Others are data URIs, unless a folder is named and base64 isn't asked for: then they are
    files of that folder, by the last part of their source, or numbered over all of a document's files where it has none. Links
    take the alias instead of the folder; without one they lead there from output_dir, if that is given. Two images with one
    source name are one file.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source, alt = part("source"), part("alt")
    held = F.coalesce(F.length("content") > 0, F.lit(False))
    named = F.when(alt != "", alt).otherwise(source)
    linked = F.concat(F.lit("!["), alt, F.lit("]("), link_destination(source, F.lit("")), F.lit(")"))
    if not folder or as_base64:
        inline = F.concat(F.lit("!["), named, F.lit("](data:"), part("content_type"), F.lit(";base64,"), F.base64("content"), F.lit(")"))
        # base64() breaks lines, which a link can't hold
        return images.withColumn("markdown", F.when(held, F.regexp_replace(inline, "\r\n", "")).otherwise(linked)).withColumn("file", F.lit(None).cast("string"))
    rows = running(images.withColumn("__held", held.cast("int")), by, [order], {"__number": Scan("sum", F.col("__held"))}, hot_rows)
    ending = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _ENDINGS.items() for x in pair]), part("content_type")), F.lit(".png"))
    last = F.element_at(F.split(F.regexp_replace(source, r"(/|(^|/)\.(?=/|$))+$", ""), "/", -1), -1)
    file = F.when(last != "", last).otherwise(F.concat(F.lit("image"), F.col("__number").cast("string"), ending))
    at = alias.rstrip("/") if alias else posixpath.relpath(folder, output_dir) if output_dir is not None else folder
    prefix = "" if not alias and posixpath.normpath(at) == "." else f"{at if alias else posixpath.normpath(at)}/"
    shown = F.concat(F.lit("!["), named, F.lit("]("), F.lit(prefix), file, F.lit(")"))
    path = F.concat(F.lit(f"{posixpath.normpath(folder)}/"), file)
    return rows.select(*images.columns, F.when(held, shown).otherwise(linked).alias("markdown"), F.when(held, path).alias("file"))
