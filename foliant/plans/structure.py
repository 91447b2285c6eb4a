"""Queries of the structural operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import cascading, layout, markdown_blocks, running, structure


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, one for each order and line number; an order's lie together."""
    keys = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    li = _t(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*keys)).alias("s"))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("s.l_partkey").alias("p"), F.col("s.l_suppkey").alias("s"), F.col("s.l_quantity").cast("int").alias("q"), F.col("s.l_returnflag").alias("f"))


_LINES = "(SELECT l_orderkey AS doc_id, l_linenumber AS ord, r.a AS p, r.b AS s, CAST(r.c AS INT) AS q, r.d AS f FROM (SELECT l_orderkey, l_linenumber, min({'a': l_partkey, 'b': l_suppkey, 'c': l_quantity, 'd': l_returnflag}) AS r FROM lineitem GROUP BY ALL))"


def child_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents of customers (tables), their orders (rows) and lines (cells): cells below each table at any depth, and its rows."""
    c, o = _t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    row = c.join(o, F.col("c_custkey") == F.col("o_custkey"))
    cell = row.join(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"))
    node = lambda rows, kind, *keys: rows.select(F.col("c_nationkey").cast("long").alias("doc_id"), F.array(*[F.col(k).cast("int") for k in keys]).alias("path"), F.lit(kind).alias("type"))
    nodes = node(c, "table", "c_custkey").unionByName(node(row, "row", "c_custkey", "o_orderkey")).unionByName(node(cell, "cell", "c_custkey", "o_orderkey", "l_linenumber"))
    nodes = nodes.unionByName(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.array().cast("array<int>").alias("path"), F.lit("document").alias("type")))
    nodes = structure.distinct_nodes(nodes)
    found = [structure.child_nodes(nodes, *a, distinct=True).withColumn("which", F.lit(w)) for w, a in (("cells", ("table", "cell", True)), ("rows", ("table", "row", False)), ("all", ("document", None, True)))]
    both = found[0].unionByName(found[1]).unionByName(found[2])
    return both.groupBy("which", "doc_id", F.coalesce(F.get("origin", F.lit(0)), F.lit(-1)).cast("long").alias("origin")).agg(F.count("*").alias("n"))


def field_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as inlines of their order: field marks and runs by part key, some runs with the code of a link."""
    p = F.col("p").cast("string")
    kind = F.get(F.array(*map(F.lit, ("field_start", "field_separator", "field_end", "run", "run"))), (F.col("p") % 5).cast("int"))
    code = F.concat(F.lit(' HYPERLINK "http://h.example/(p'), p, F.lit(')" '), F.when(F.col("s") % 2 == 0, F.concat(F.lit('\\o "tip '), p, F.lit('" '))).otherwise(F.concat(F.lit('\\l "at'), p, F.lit('" '))))
    text = F.when(F.col("s") % 3 == 0, code).when(F.col("s") % 7 == 1, "").otherwise(F.concat(F.lit("w"), p, F.lit(";")))
    inlines = _lines(spark, sf_dir).select("doc_id", "ord", kind.alias("kind"), text.alias("text"))
    return structure.folded_fields(inlines, ["doc_id"])


def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six orders as a table: a line is a cell, its span from the quantity, its merge from the return flag."""
    merge = F.when(F.col("f") == "A", "restart").when(F.col("f") == "N", "continue")
    cells = _lines(spark, sf_dir).select(F.floor(F.col("doc_id") / 6).alias("table_id"), (F.col("doc_id") % 6).cast("int").alias("row_idx"), F.col("ord").alias("col_idx"), (1 + F.col("q") % 3).alias("grid_span"), merge.alias("v_merge"))
    return structure.cell_grid(cells, ["table_id"]).select("table_id", *[F.col(c).cast("long").alias(c) for c in ("row_idx", "grid_col", "row_span", "col_span")])


# Number styles, formats and starts of the list that order lines are items of.
_LEVELS = ((0, "%1.", 1), (1, "%1.%2.", 3), (4, "%1.%2.%3)", 0), (0, "%4-%1", 2))


def level_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items of a list of four levels, their level from the quantity; a fifth level is beyond the list."""
    levels = F.array(*[F.struct(F.lit(s).alias("number_style"), F.lit(f).alias("number_format"), F.lit(n).alias("start_at")) for s, f, n in _LEVELS])
    items = _lines(spark, sf_dir).select("doc_id", F.lit(1).alias("list_id"), "ord", (F.col("q") % 5).alias("level"))
    lists = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).distinct().select("doc_id", F.lit(1).alias("list_id"), levels.alias("levels"))
    return structure.level_labels(items, lists).select("doc_id", F.col("ord").cast("long").alias("ord"), F.coalesce("label", F.lit("none")).alias("label"))


def list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as paragraphs: some of them items, bullets by part key, blank ones and those of tables between."""
    rows = _lines(spark, sf_dir).select("doc_id", "ord", (F.col("q") % 4).alias("list_ref"), (F.col("p") % 3 == 0).alias("is_bullet"), F.when(F.col("s") % 9 == 0, "  ").otherwise("x").alias("text"), (F.col("s") % 11 == 0).alias("in_table"))
    return structure.list_groups(rows).select("doc_id", F.col("ord").cast("long").alias("ord"), F.coalesce("group_id", F.lit(0)).cast("long").alias("group_id"))


def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as characters of their user's document, sign-ups as the starts of its sections: the section of each event."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("cp"), "event_type")
    marks = e.where("event_type = 'signup'").select("doc_id", "cp", F.col("cp").alias("section"))
    return running.nearest_before(e.drop("event_type"), marks, ["doc_id"], "cp", ["section"]).select("doc_id", "cp", F.coalesce("section", F.lit(-1)).alias("section"))


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as styles of their nation's document, numbered there: each is based on the one of half its number."""
    n = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", n.alias("n"))
    name = lambda c: F.concat(F.lit("S"), F.col("s_nationkey").cast("string"), F.lit("_"), c.cast("string"))
    k = F.col("s_suppkey")
    return s.select(
        F.col("s_nationkey").cast("long").alias("doc_id"), "n", F.col("n").alias("ord"), name(F.col("n")).alias("name"), F.when(F.col("n") > 1, name(F.floor(F.col("n") / 2))).alias("base_style_name"), name(F.col("n") + 3).alias("next_style"),
        F.when(k % 3 == 1, k * 2).alias("size"), F.when(k % 4 == 0, F.concat(F.lit("C"), k.cast("string"))).when(k % 4 == 1, "").alias("color"),
    )


_STYLES = "(SELECT CAST(s_nationkey AS BIGINT) AS doc_id, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)"
_CHAIN = f"s AS {_STYLES}, c AS (SELECT doc_id, n AS top, 0 AS depth, n FROM s UNION ALL SELECT doc_id, top, depth + 1, n // 2 FROM c WHERE n > 1)"


def style_chain_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascading.style_chains(_styles(spark, sf_dir)).select("name", F.col("depth").cast("long").alias("depth"), "ancestor")


def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _styles(spark, sf_dir)
    return cascading.cascade(s, cascading.style_chains(s), ["size"]).select("name", F.coalesce("size", F.lit(-1)).cast("long").alias("size"))


def run_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs of their nation's document, with styles of three layers, values of their own, and defaults."""
    c = _t(spark, sf_dir, "customer")
    k, doc = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    style = lambda n, where: F.when(where, F.concat(F.lit("S"), doc, F.lit("_"), n.cast("string")))
    runs = c.select(
        F.col("c_nationkey").cast("long").alias("doc_id"), k.alias("run_id"), style(k % 5 + 1, k % 2 == 0).alias("table_style"), style(k % 7 + 1, k % 3 > 0).alias("para_style"), style(k % 4 + 2, k % 6 == 5).alias("run_style"),
        F.when(k % 9 == 0, k).alias("size"), F.when(k % 10 == 0, "own").when(k % 10 == 1, "").alias("color"),
    )
    found = cascading.resolved_runs(runs, _styles(spark, sf_dir), ["size", "color"], {"size": F.lit(22), "color": F.lit("auto")}, empty={"color": ""})
    return found.select("doc_id", "run_id", F.col("size").cast("long").alias("size"), "color")


def styles_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those styles the ones that the second of each document reaches by base and next styles."""
    s = _styles(spark, sf_dir)
    return cascading.used_styles(s.where("n = 2"), s, ["base_style_name", "next_style"])


def group_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as groups within their nation's document, customers as shapes in them."""
    g = _styles(spark, sf_dir)
    n = F.col("n")
    groups = g.select("doc_id", n.alias("group_id"), F.when(n > 1, F.floor(n / 2)).alias("parent_id"), (n * 16).alias("x"), (n * 8).alias("y"), (n % 3 * 4).alias("ch_x"), F.lit(None).cast("int").alias("ch_y"), F.pow(F.lit(2.0), n % 3 - 1).alias("sx"), F.when(n % 2 == 0, 0.5).alias("sy"))
    k = F.col("c_custkey")
    shapes = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), k.alias("shape_id"), (k % 9).alias("group_id"), (k % 100).alias("x"), (k % 50).alias("y"), F.lit(64).alias("cx"), F.lit(32).alias("cy"))
    return structure.group_boxes(groups, shapes, unit=8.0).select("doc_id", "shape_id", "left", "top", "width", "height")


def page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines that a supplier ships as blocks of its document, as tall as their quantity: their pages."""
    blocks = _lines(spark, sf_dir).select(F.col("s").alias("supplier"), (F.col("doc_id") * 10 + F.col("ord")).alias("ord"), (F.col("q") * F.when(F.col("p") % 50 == 0, 9).otherwise(1)).alias("height"))
    return layout.page_numbers(blocks, ["supplier"], "ord", 300.0)


def column_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as blocks of a section of one to four columns, their height from their key."""
    o = _t(spark, sf_dir, "orders")
    blocks = o.select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 37).alias("height"), (1 + F.col("o_custkey") % 4).alias("columns")).dropDuplicates(["section", "ord"])
    return layout.balanced_columns(blocks, ["section"], "ord", 30.0, 20.0, 400.0).select("section", "ord", F.col("column_idx").cast("long").alias("column_idx"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six orders as a table, each a row, their lines the cells."""
    return _lines(spark, sf_dir).select(F.floor(F.col("doc_id") / 6).alias("table_id"), (F.col("doc_id") % 6).cast("int").alias("row_idx"), (F.col("ord") - 1).cast("int").alias("col_idx"), "p", "s", "q", "f")


def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of those tables' columns, some of which state none, and heights of their rows."""
    c = _cells(spark, sf_dir).select("table_id", "row_idx", "col_idx", F.when(F.col("p") % 4 == 0, F.col("q").cast("double")).alias("width"), F.col("p").cast("double").alias("text_width"), F.when(F.col("s") % 5 == 0, 20.0).alias("row_height"), (F.col("p") % 3 > 0).alias("wrap"), (F.col("p") % 7 == 0).alias("vertical"))
    w = layout.column_widths(c, ["table_id"], 170.0)
    h = layout.row_heights(c.drop("width"), w, ["table_id"])
    one = lambda rows, kind, at, v: rows.select("table_id", F.lit(kind).alias("kind"), F.col(at).cast("long").alias("at"), F.round(v, 6).alias("size"))
    return one(w, "column", "col_idx", "width").unionByName(one(h, "row", "row_idx", "height"))


def edge_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders of those tables: cells state some by their keys, tables and styles others."""
    border = lambda when, width: F.when(when, F.struct(F.lit(0).alias("line_style"), width.cast("double").alias("line_width")))
    c = _cells(spark, sf_dir).select("table_id", "row_idx", "col_idx", border(F.col("p") % 2 == 0, F.col("q") % 3).alias("top"), border(F.col("p") % 3 == 0, F.col("q") % 4).alias("bottom"), border(F.col("s") % 2 == 0, F.col("q") % 5).alias("left"), border(F.col("s") % 3 == 0, F.col("q") % 2).alias("right"))
    t = F.col("table_id")
    own = F.when(t % 3 > 0, F.struct(border(t % 2 == 0, t % 3).alias("top"), border(t % 2 == 0, F.lit(11)).alias("bottom"), border(t % 2 == 1, F.lit(12)).alias("left"), border(t % 2 == 1, F.lit(13)).alias("right"), border(t % 5 == 0, F.lit(0)).alias("inside_h"), border(t % 5 == 1, F.lit(14)).alias("inside_v")))
    style = F.when(t % 7 > 0, F.struct(*[border(t % 7 > 0, F.lit(20 + k)).alias(n) for k, n in enumerate(("top", "bottom", "left", "right", "inside_h", "inside_v"))]))
    tables = c.select("table_id").distinct().select("table_id", own.alias("own"), style.alias("style"))
    found = layout.edge_borders(c, tables, ["table_id"])
    return found.select("table_id", "edge", F.col("line").cast("long").alias("line"), F.col("place").cast("long").alias("place"), F.col("border.line_width").alias("width"))


def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as images of their nation's document: as data, as files, and as files under an alias."""
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    images = _t(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("doc_id"), k.alias("ord"), F.when(k % 5 > 0, F.col("c_mktsegment").cast("binary")).alias("content"),
        F.when(k % 3 == 0, F.concat(F.lit("media/pic (1) "), key, F.lit(".gif"))).when(k % 3 == 1, "").alias("source"), F.when(k % 4 > 0, F.concat(F.lit("alt "), key)).alias("alt"), F.when(k % 2 == 0, "image/jpeg").otherwise("image/webp").alias("content_type"),
    )
    modes = {"data": {}, "files": {"folder": "out/images", "output_dir": "out"}, "alias": {"folder": "out/images", "alias": "http://cdn.example/i/"}}
    found = [structure.image_links(images, ["doc_id"], **how).select(F.lit(mode).alias("mode"), "doc_id", "ord", "markdown", F.coalesce("file", F.lit("")).alias("file")) for mode, how in modes.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _text_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(tx.split_lines(F.col("text"))).alias("ord", "text"))


def md_block_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of each supplier with blocks of every kind, nested ones too: all blocks by their paths, from rows of lines."""
    s = _t(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey").cast("string"))
    text = F.concat(
        F.lit("Title "), "k", F.lit("\nof it\n=====\n\nSee `code` and\n  [Text][ref]\n\n> quoted "), "k", F.lit("\nlazy\n> > deeper\n> ```\n> x\n\n3. three\n\n   still three\n4. four\n   - inner\n     > "), "k",
        F.lit("\n\n````py\nx = "), "k", F.lit("\n```\n````\n\n    indented\n\n      more\n\n| a | b |\n|--|--|\n| "), "k", F.lit(" | c\\|d |\n***\nSub\n---\n## Head "), "k",
        F.lit(" ##\n[REF]:\n  http://r.example/"), "k", F.lit('\n  "T"\n\n[^n]: Body '), "k", F.lit("\n\n    of it\n<div>\nraw\n\nend\n~~~~\nopen"),
    )
    found = markdown_blocks.markdown_blocks(_text_lines(s.select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))))
    return found.select("doc_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "kind", "text", F.col("level").cast("long").alias("level"), "info")


_BLOCKS = (
    ("0", "setext", "'Title ' || k || chr(10) || 'of it'", 1, ""), ("1", "paragraph", "'See `code` and' || chr(10) || '[Text][ref]'", 0, ""), ("2", "quote", "''", 0, ""), ("2.0", "paragraph", "'quoted ' || k || chr(10) || 'lazy'", 0, ""), ("2.1", "quote", "''", 0, ""),
    ("2.1.0", "paragraph", "'deeper'", 0, ""), ("2.2", "fence", "'x'", 0, ""), ("3", "item", "''", 1, "."), ("3.0", "paragraph", "'three'", 0, ""), ("3.1", "paragraph", "'still three'", 0, ""), ("4", "item", "''", 1, "."), ("4.0", "paragraph", "'four'", 0, ""), ("4.1", "item", "''", 0, "-"),
    ("4.1.0", "paragraph", "'inner'", 0, ""), ("4.1.1", "quote", "''", 0, ""), ("4.1.1.0", "paragraph", "k", 0, ""), ("5", "fence", "'x = ' || k || chr(10) || '```'", 0, "py"), ("6", "code", "'indented' || chr(10) || chr(10) || '  more'", 0, ""),
    ("7", "table", "'a' || chr(9) || 'b' || chr(10) || k || chr(9) || 'c|d'", 0, ""), ("8", "rule", "''", 0, ""), ("9", "setext", "'Sub'", 2, ""), ("10", "heading", "'Head ' || k", 2, ""), ("11", "definition", "''", 0, ""), ("12", "footnote", "''", 0, "n"), ("12.0", "paragraph", "'Body ' || k", 0, ""),
    ("12.1", "paragraph", "'of it'", 0, ""), ("13", "html", "'<div>' || chr(10) || 'raw'", 0, ""), ("14", "paragraph", "'end'", 0, ""), ("15", "fence", "'open'", 1, ""),
)


def md_table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe table of each customer's orders, read back as rows of its block."""
    o = _t(spark, sf_dir, "orders")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), F.lit(" |"))
    rows = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), row.alias("text"))
    head = o.select(F.col("o_custkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("ord"), F.lit(t).alias("text")) for k, t in ((-2, "| key | status | priority |"), (-1, "|--:|:-:|---|"))])).alias("h")).select("doc_id", "h.*")
    tables = markdown_blocks.markdown_blocks(head.unionByName(rows)).where("kind = 'table'")
    cells = tables.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "row")).where("n > 0")
    return cells.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum(F.split("row", "\t")[0].cast("long")).alias("sum_keys"))


_SQL = {
    "md_block_structure": " UNION ALL ".join(f"SELECT s_suppkey AS doc_id, '{p}' AS path, '{kind}' AS kind, {text} AS text, CAST({level} AS BIGINT) AS level, '{info}' AS info FROM (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS k FROM supplier)" for p, kind, text, level, info in _BLOCKS),
    "md_table_blocks": "SELECT o_custkey AS doc_id, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS sum_keys FROM orders GROUP BY 1",
    "image_links": r"""
        WITH i AS (SELECT CAST(c_nationkey AS BIGINT) AS d, c_custkey AS k, c_custkey % 5 > 0 AS held, c_mktsegment AS m, CASE WHEN c_custkey % 3 = 0 THEN 'media/pic (1) ' || c_custkey || '.gif' ELSE '' END AS s, CASE WHEN c_custkey % 4 > 0 THEN 'alt ' || c_custkey ELSE '' END AS alt, CASE WHEN c_custkey % 2 = 0 THEN 'image/jpeg' ELSE 'image/webp' END AS t FROM customer),
        n AS (SELECT *, count(*) FILTER (WHERE held) OVER (PARTITION BY d ORDER BY k) AS n, CASE WHEN alt = '' THEN s ELSE alt END AS name, '![' || alt || '](' || CASE WHEN s = '' THEN '' ELSE '<' || s || '>' END || ')' AS linked FROM i),
        f AS (SELECT *, CASE WHEN s <> '' THEN 'pic (1) ' || k || '.gif' ELSE 'image' || n || CASE WHEN k % 2 = 0 THEN '.jpg' ELSE '.png' END END AS file FROM n)
        SELECT 'data' AS mode, d AS doc_id, k AS ord, CASE WHEN held THEN '![' || name || '](data:' || t || ';base64,' || base64(encode(m)) || ')' ELSE linked END AS markdown, '' AS file FROM f
        UNION ALL SELECT 'files', d, k, CASE WHEN held THEN '![' || name || '](images/' || file || ')' ELSE linked END, CASE WHEN held THEN 'out/images/' || file ELSE '' END FROM f
        UNION ALL SELECT 'alias', d, k, CASE WHEN held THEN '![' || name || '](http://cdn.example/i/' || file || ')' ELSE linked END, CASE WHEN held THEN 'out/images/' || file ELSE '' END FROM f""",
    "page_breaks": f"""
        WITH RECURSIVE b AS (SELECT s AS supplier, doc_id * 10 + ord AS ord, q * CASE WHEN p % 50 = 0 THEN 9 ELSE 1 END AS height, row_number() OVER (PARTITION BY s ORDER BY doc_id * 10 + ord) AS i FROM {_LINES}),
        w AS (SELECT supplier, ord, height, i, 1 AS page, height AS y FROM b WHERE i = 1
            UNION ALL SELECT b.supplier, b.ord, b.height, b.i, CASE WHEN w.y + b.height > 300 THEN page + 1 ELSE page END, CASE WHEN w.y + b.height > 300 THEN b.height ELSE w.y + b.height END FROM w JOIN b ON b.supplier = w.supplier AND b.i = w.i + 1)
        SELECT supplier, ord, height, CAST(page AS BIGINT) AS page FROM w""",
    "column_balance": """
        WITH RECURSIVE b AS (SELECT DISTINCT o_custkey AS section, o_orderkey AS ord, o_orderkey % 37 AS h, 1 + o_custkey % 4 AS n FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY ord) AS i, least(30 + sum(h) OVER (PARTITION BY section)::DOUBLE / n, 400) AS target, sum(h) OVER (PARTITION BY section) AS total FROM b),
        w AS (SELECT section, 0::BIGINT AS i, 0::BIGINT AS ord, 0 AS col, 30.0::DOUBLE AS y FROM r GROUP BY section
            UNION ALL SELECT r.section, r.i, r.ord, CASE WHEN goes THEN col + 1 ELSE col END, CASE WHEN goes THEN 20 ELSE y END + h FROM (SELECT r.*, w.col, w.y, w.col < r.n - 1 AND r.total > 0 AND w.y + r.h / 2.0::DOUBLE > r.target AS goes FROM w JOIN r ON r.section = w.section AND r.i = w.i + 1) r)
        SELECT section, ord, CAST(col AS BIGINT) AS column_idx FROM w WHERE i > 0""",
    "table_sizes": f"""
        WITH c AS (SELECT doc_id // 6 AS t, doc_id % 6 AS r, ord - 1 AS c, CASE WHEN p % 4 = 0 THEN q::DOUBLE END AS w, p::DOUBLE AS tw, CASE WHEN s % 5 = 0 THEN 20.0::DOUBLE END AS rh, p % 3 > 0 AS wrap, p % 7 = 0 AS vert FROM {_LINES}),
        n AS (SELECT t, max(c) + 1 AS n FROM c GROUP BY t), g AS (SELECT t, unnest(range(n)) AS c, n FROM n),
        w AS (SELECT g.t, g.c, g.n, coalesce(max(w), 0) AS w FROM g LEFT JOIN c ON c.t = g.t AND c.c = g.c GROUP BY ALL),
        s AS (SELECT *, sum(w) OVER (PARTITION BY t) AS total, count(*) FILTER (WHERE w = 0) OVER (PARTITION BY t) AS zero FROM w),
        f AS (SELECT t, c, CASE WHEN zero = n THEN 170.0::DOUBLE / n WHEN w > 0 THEN w WHEN total < 170 THEN (170 - total) / zero ELSE 0 END AS w FROM s),
        v AS (SELECT t, c, w * least(1, 170 / sum(w) OVER (PARTITION BY t)) AS w FROM f)
        SELECT t AS table_id, 'column' AS kind, c AS at, round(w, 6) AS size FROM v
        UNION ALL SELECT c.t, 'row', r, round(greatest(5.5::DOUBLE, coalesce(max(CASE WHEN vert THEN tw + 1 WHEN NOT wrap THEN 5.62::DOUBLE WHEN v.w > 3 THEN ceil(tw / (v.w - 2) - 1e-6::DOUBLE) * 4.62::DOUBLE + 1 END), 0), coalesce(max(rh), 0)), 6) FROM c JOIN v ON v.t = c.t AND v.c = c.c GROUP BY c.t, r""",
    "edge_borders": f"""
        WITH c AS (SELECT doc_id // 6 AS t, doc_id % 6 AS r, ord - 1 AS c, CASE WHEN p % 2 = 0 THEN q % 3 END AS top, CASE WHEN p % 3 = 0 THEN q % 4 END AS bottom, CASE WHEN s % 2 = 0 THEN q % 5 END AS lft, CASE WHEN s % 3 = 0 THEN q % 2 END AS rgt FROM {_LINES}),
        z AS (SELECT *, max(r) OVER (PARTITION BY t) AS mr, max(c) OVER (PARTITION BY t) AS mc, t % 3 > 0 AS has, t % 7 > 0 AS st FROM c),
        -- the entry of the layers for each side: the table's own, else the style's
        e AS (SELECT *, CASE WHEN r = 0 THEN coalesce(CASE WHEN has AND t % 2 = 0 THEN t % 3 END, CASE WHEN st THEN 20 END) ELSE h END AS et, CASE WHEN r = mr THEN coalesce(CASE WHEN has AND t % 2 = 0 THEN 11 END, CASE WHEN st THEN 21 END) ELSE h END AS eb,
                CASE WHEN c = 0 THEN coalesce(CASE WHEN has AND t % 2 = 1 THEN 12 END, CASE WHEN st THEN 22 END) ELSE v END AS el, CASE WHEN c = mc THEN coalesce(CASE WHEN has AND t % 2 = 1 THEN 13 END, CASE WHEN st THEN 23 END) ELSE v END AS er
            FROM (SELECT *, coalesce(CASE WHEN has AND t % 5 = 0 THEN 0 END, CASE WHEN st THEN 24 END) AS h, coalesce(CASE WHEN has AND t % 5 = 1 THEN 14 END, CASE WHEN st THEN 25 END) AS v FROM z)),
        d AS (SELECT t, 'h' AS edge, r AS line, c AS place, r, c, 0 AS k, CASE WHEN top > 0 THEN top WHEN et > 0 THEN et END AS w FROM e UNION ALL SELECT t, 'h', r + 1, c, r, c, 1, CASE WHEN bottom > 0 THEN bottom WHEN eb > 0 THEN eb END FROM e
            UNION ALL SELECT t, 'v', c, r, r, c, 2, CASE WHEN lft > 0 THEN lft WHEN el > 0 THEN el END FROM e UNION ALL SELECT t, 'v', c + 1, r, r, c, 3, CASE WHEN rgt > 0 THEN rgt WHEN er > 0 THEN er END FROM e)
        SELECT t AS table_id, edge, CAST(line AS BIGINT) AS line, CAST(place AS BIGINT) AS place, w::DOUBLE AS width FROM d WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t, edge, line, place ORDER BY r DESC, c DESC, k DESC) = 1""",
    "child_nodes": """
        WITH r AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON c_custkey = o_custkey), l AS (SELECT DISTINCT doc_id, c, o, l_linenumber FROM r JOIN lineitem ON l_orderkey = o)
        SELECT 'cells' AS which, doc_id, c AS origin, count(*) AS n FROM l GROUP BY doc_id, c UNION ALL SELECT 'rows', doc_id, c, count(*) FROM r GROUP BY doc_id, c
        UNION ALL SELECT 'all', doc_id, -1, count(*) FROM (SELECT doc_id FROM r UNION ALL SELECT doc_id FROM l UNION ALL SELECT CAST(c_nationkey AS BIGINT) FROM customer) GROUP BY doc_id""",
    "field_folding": rf"""
        WITH RECURSIVE i AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i, p % 5 AS k, CASE WHEN s % 3 = 0 THEN ' HYPERLINK "http://h.example/(p' || p || ')" ' || CASE WHEN s % 2 = 0 THEN '\o "tip ' || p || '" ' ELSE '\l "at' || p || '" ' END WHEN s % 7 = 1 THEN '' ELSE 'w' || p || ';' END AS t FROM {_LINES}),
        w AS (SELECT doc_id, 0::BIGINT AS i, '' AS shown, []::STRUCT(code VARCHAR, res VARCHAR, sep BOOLEAN)[] AS st FROM i GROUP BY doc_id
            UNION ALL SELECT w.doc_id, i.i,
                CASE WHEN k >= 3 AND len(st) = 0 THEN shown || t WHEN k = 2 AND len(st) = 1 THEN shown || f ELSE shown END,
                CASE WHEN k = 0 THEN list_append(st, {{'code': '', 'res': '', 'sep': false}})
                     WHEN len(st) = 0 THEN st
                     WHEN k = 1 THEN list_append(st[:-2], {{'code': top.code, 'res': top.res, 'sep': true}})
                     WHEN k = 2 AND len(st) = 1 THEN []
                     WHEN k = 2 THEN list_append(st[:-3], {{'code': st[-2].code, 'res': st[-2].res || f, 'sep': st[-2].sep}})
                     WHEN top.sep THEN list_append(st[:-2], {{'code': top.code, 'res': top.res || t, 'sep': true}})
                     ELSE list_append(st[:-2], {{'code': top.code || t, 'res': top.res, 'sep': false}}) END
            FROM (SELECT *, st[-1] AS top, CASE WHEN len(st) > 0 AND starts_with(trim(st[-1].code), 'HYPERLINK') AND st[-1].res <> '' THEN '[' || st[-1].res || '](' || replace(replace(regexp_extract(trim(st[-1].code), '^HYPERLINK "([^"]*)"', 1), '(', '\('), ')', '\)')
                || coalesce('#' || regexp_extract_all(st[-1].code, '\\l "([^"]*)"', 1)[-1], '') || coalesce(' "' || regexp_extract_all(st[-1].code, '\\o "([^"]*)"', 1)[-1] || '"', '') || ')' WHEN len(st) > 0 THEN st[-1].res ELSE '' END AS f FROM w) w JOIN i ON i.doc_id = w.doc_id AND i.i = w.i + 1)
        SELECT doc_id, shown AS text FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1""",
    "cell_grid": f"""
        WITH RECURSIVE c AS (SELECT doc_id // 6 AS t, doc_id % 6 AS r, 1 + q % 3 AS w, f, sum(1 + q % 3) OVER (PARTITION BY doc_id ORDER BY ord) - (1 + q % 3) AS g FROM {_LINES}),
        -- a cell that doesn't go on from the one above, then as many as go on below it
        m AS (SELECT c.*, coalesce(c.f = 'N' AND u.f IN ('A', 'N'), false) AS on_ FROM c LEFT JOIN c u ON u.t = c.t AND u.g = c.g AND u.r = c.r - 1),
        s AS (SELECT t, r, g, w, r AS z FROM m WHERE NOT on_ UNION ALL SELECT s.t, s.r, s.g, s.w, m.r FROM s JOIN m ON m.t = s.t AND m.g = s.g AND m.r = s.z + 1 AND m.on_)
        SELECT t AS table_id, CAST(r AS BIGINT) AS row_idx, CAST(g AS BIGINT) AS grid_col, CAST(max(z) - r + 1 AS BIGINT) AS row_span, CAST(any_value(w) AS BIGINT) AS col_span FROM s GROUP BY t, r, g""",
    "level_labels": f"""
        WITH RECURSIVE i AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i, least(q % 5, 3) AS k, doc_id IN (SELECT o_orderkey FROM orders) AS known FROM {_LINES}),
        w AS (SELECT doc_id, 0::BIGINT AS i, 0 AS ord, 0 AS k, false AS known, 0 AS a, 0 AS b, 0 AS c, 0 AS d FROM i GROUP BY doc_id
            UNION ALL SELECT i.doc_id, i.i, i.ord, i.k, i.known, CASE WHEN i.k = 0 THEN a + 1 ELSE a END,
                CASE WHEN i.k = 0 THEN 0 WHEN i.k > 1 THEN b WHEN b = 0 THEN 3 ELSE b + 1 END, CASE WHEN i.k < 2 THEN 0 WHEN i.k > 2 THEN c ELSE c + 1 END, CASE WHEN i.k < 3 THEN 0 WHEN d = 0 THEN 2 ELSE d + 1 END
            FROM w JOIN i ON i.doc_id = w.doc_id AND i.i = w.i + 1),
        r AS (SELECT *, (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI'])[b + 1] AS rb FROM w WHERE i > 0)
        SELECT doc_id, CAST(ord AS BIGINT) AS ord, CASE WHEN NOT known THEN 'none' WHEN k = 0 THEN a || '.' WHEN k = 1 THEN a || '.' || rb || '.' WHEN k = 2 THEN a || '.' || rb || '.' || CASE WHEN c = 0 THEN '' ELSE chr(96 + c) END || ')' ELSE d || '-' || a END AS label FROM r""",
    "list_groups": f"""
        WITH r AS (SELECT doc_id, ord, CASE WHEN q % 4 > 0 AND s % 9 <> 0 AND s % 11 <> 0 THEN CAST(p % 3 = 0 AS INT) END AS kind FROM {_LINES}),
        b AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM r)
        SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(CASE WHEN kind IS NULL THEN 0 ELSE 1000 + sum(CASE WHEN kind IS NOT NULL AND prev IS DISTINCT FROM kind THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) END AS BIGINT) AS group_id FROM b""",
    "section_lookup": "SELECT e.user_id AS doc_id, e.event_id AS cp, coalesce(m.event_id, -1) AS section FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') m ON e.user_id = m.user_id AND e.event_id >= m.event_id",
    "style_chain_recursive": f"WITH RECURSIVE {_CHAIN} SELECT 'S' || doc_id || '_' || top AS name, CAST(depth AS BIGINT) AS depth, 'S' || doc_id || '_' || n AS ancestor FROM c",
    "style_cascade": f"WITH RECURSIVE {_CHAIN} SELECT 'S' || doc_id || '_' || top AS name, CAST(coalesce(arg_min(2 * k, depth) FILTER (WHERE k % 3 = 1), -1) AS BIGINT) AS size FROM c JOIN s USING (doc_id, n) GROUP BY doc_id, top",
    "run_formats": f"""
        WITH RECURSIVE {_CHAIN}, v AS (SELECT doc_id, top AS n, arg_min(2 * k, depth) FILTER (WHERE k % 3 = 1) AS size, arg_min('C' || k, depth) FILTER (WHERE k % 4 = 0) AS color FROM c JOIN s USING (doc_id, n) GROUP BY doc_id, top),
        r AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 + 1 END AS t, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 7 + 1 END AS p, CASE WHEN c_custkey % 6 = 5 THEN c_custkey % 4 + 2 END AS x FROM customer)
        SELECT r.doc_id, k AS run_id, CAST(coalesce(CASE WHEN k % 9 = 0 THEN k END, x.size, p.size, t.size, 22) AS BIGINT) AS size, coalesce(CASE WHEN k % 10 = 0 THEN 'own' END, x.color, p.color, t.color, 'auto') AS color
        FROM r LEFT JOIN v t ON t.doc_id = r.doc_id AND t.n = r.t LEFT JOIN v p ON p.doc_id = r.doc_id AND p.n = r.p LEFT JOIN v x ON x.doc_id = r.doc_id AND x.n = r.x""",
    "styles_in_use": f"WITH RECURSIVE s AS {_STYLES}, u AS (SELECT doc_id, n FROM s WHERE n = 2 UNION SELECT u.doc_id, s.n FROM u JOIN s ON s.doc_id = u.doc_id AND (s.n = u.n // 2 OR s.n = u.n + 3)) SELECT doc_id, 'S' || doc_id || '_' || n AS name FROM u",
    "group_boxes": f"""
        WITH RECURSIVE s AS {_STYLES}, g AS (SELECT doc_id, n, 2.0::DOUBLE ** (n % 3 - 1) AS sx, CASE WHEN n % 2 = 0 THEN 0.5 ELSE 1 END::DOUBLE AS sy FROM s),
        -- given: the scale of what surrounds a group
        w AS (SELECT doc_id, n, 16 * n / 8.0::DOUBLE AS x, n::DOUBLE AS y, 1.0::DOUBLE AS gx, 1.0::DOUBLE AS gy, sx, sy FROM g WHERE n = 1
            UNION ALL SELECT g.doc_id, g.n, w.x + 16 * g.n * w.gx / 8.0::DOUBLE, w.y + 8 * g.n * w.gy / 8.0::DOUBLE, w.sx, w.sy, w.sx * g.sx, w.sy * g.sy FROM w JOIN g ON g.doc_id = w.doc_id AND g.n // 2 = w.n AND g.n > 1)
        SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS shape_id, coalesce(w.x + (c_custkey % 100 - w.n % 3 * 4) * w.sx / 8, c_custkey % 100 / 8.0::DOUBLE) AS left, coalesce(w.y + c_custkey % 50 * w.sy / 8, c_custkey % 50 / 8.0::DOUBLE) AS top, coalesce(8 * w.sx, 8) AS width, coalesce(4 * w.sy, 4) AS height
        FROM customer LEFT JOIN w ON w.doc_id = c_nationkey AND w.n = c_custkey % 9""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (child_nodes, field_folding, cell_grid, level_labels, list_groups, section_lookup, style_chain_recursive, style_cascade, run_formats, styles_in_use, group_boxes, page_breaks, column_balance, table_sizes, edge_borders, image_links, md_block_structure, md_table_blocks)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
