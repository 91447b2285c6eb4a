"""The engine's queries on the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import formats as fmt
from foliant.functions import styles as st
from foliant.functions import text as tx
from foliant.operators import relational as rel
from foliant.plans import structure
from foliant.sources import documents as src


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(docs: DataFrame) -> DataFrame:
    """Paragraphs of plain text: a line each, empty ones included."""
    return docs.select("doc_id", "lang", F.posexplode(tx.split_lines(F.col("text"))).alias("ord", "text"))


_LINES = r"(SELECT doc_id, lang, unnest(l) AS text, unnest(range(len(l))) AS ord FROM (SELECT doc_id, lang, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, lang, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)))"


def text_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, paragraphs and characters by language."""
    d = _t(spark, sf_dir, "documents")
    lines = tx.split_lines(F.col("text"))
    return d.select("lang", F.size(F.filter(lines, lambda x: x != "")).cast("long").alias("p"), F.length("text").cast("long").alias("c")).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("p").alias("n_paragraphs"), F.sum("c").alias("n_chars"))


def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(_t(spark, sf_dir, "documents")).select("doc_id", F.col("ord").cast("long").alias("ord"), "text")


def get_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of all documents with a paragraph that is not empty; each within its row."""
    d = _t(spark, sf_dir, "documents").where(F.col("text").rlike(tx.NOT_BREAK))
    return d.select("doc_id", F.array_join(F.filter(tx.split_lines(F.col("text")), lambda x: x != ""), "\n").alias("text"))


def line_block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines of all documents would begin in Markdown."""
    from pyspark.sql import Window as W

    p = _lines(_t(spark, sf_dir, "documents"))
    nxt = F.coalesce(F.lead("text").over(W.partitionBy("doc_id").orderBy("ord")), F.lit(""))
    return p.withColumn("kind", tx.line_kind(F.col("text"), nxt)).groupBy("kind").agg(F.count("*").alias("n"))


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of made-up file heads, by customer."""
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    heads = F.array(F.lit(b"PK\x03\x04xx"), F.lit(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), F.lit(b"{\\rtf1"), F.lit(b"plain"))
    c = c.withColumn("suffix", fmt.sniffed(F.get(heads, (F.col("c_custkey") % 4).cast("int"))))
    return c.groupBy("suffix").agg(F.count("*").alias("n"))


def escape_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", tx.escape_emphasis(F.regexp_replace("text", "[^\\x00-\\x7f]", "x")).alias("text"))


def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", tx.xml_escape(F.col("html"), True).alias("xml"))


#: Characters that PDF text spells another way, and how.
TYPOGRAPHIC, SPELT = "‘’‚‛“”„–—―…•‣⁃\uf0b7\uf0a7\u2009\u200a\u200b\u00a0\u2011−™", "'','\"\",,-----...·····   --(TM)"


def safe_text_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", tx.latin1_safe(F.concat("text", F.lit("€中" + TYPOGRAPHIC))).alias("text"))


def html_blocks_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(tx.html_blocks(F.col("html"))).alias("ord", "text")).select("page_id", F.col("ord").cast("long").alias("ord"), "text")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    names = F.array_sort(F.collect_list("n_name"))
    g = j.groupBy("r_regionkey", "r_name").agg(names.alias("names"))
    g = g.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("# "), "r_name", F.lit("\n\n"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("## "), x, F.lit("\n\n- **"), x, F.lit("**\n- [link](http://x.example/"), x, F.lit(")\n"))), "\n")).alias("text"))
    return src.text_documents(g, "markdown")


def html_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with references of all kinds, decoded once."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("&eacute;&#233;&#xE9;&hellip;&amp;lt;&notit;&#8217;&unknown; "), k, F.lit("&#"), (64 + F.col("p_partkey") % 26).cast("string"), F.lit(";&lt;&#38;#65;&nbsp;&"))
    return _t(spark, sf_dir, "part").select("p_partkey", tx.html_unescape(text).alias("text"))


def md_headings_from_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = src.paragraphs(_nations(spark, sf_dir))
    return rel.headings(p, 2).select("doc_id", F.col("outline_level").cast("long").alias("level"), "text")


def md_emphasis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = src.inlines(_nations(spark, sf_dir)).where("bold")
    return i.groupBy("doc_id").agg(F.count("*").alias("n_bold"), F.sum(F.length("text")).alias("n_chars"))


def md_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = src.paragraphs(_nations(spark, sf_dir)).where("list_id is not null")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.countDistinct("list_id").alias("n_lists"))


def _orders_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    cell = F.concat_ws(" | ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", cell.alias("c")))).alias("r"))
    text = F.concat(F.lit("| key | status | priority |\n|--:|:-:|---|\n"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("| "), x["c"], F.lit(" |"))), "\n"))
    return src.text_documents(rows.select(F.col("o_custkey").alias("doc_id"), text.alias("text")), "markdown")


def md_table_cells_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of pipe tables made of orders, read back."""
    p = src.paragraphs(_orders_md(spark, sf_dir)).where("story = 'cell' and row_idx > 0 and col_idx = 0")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum(F.col("text").cast("long")).alias("sum_keys"))


def md_to_docx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown to DOCX and back: headings survive."""
    docx = src.convert(_nations(spark, sf_dir), "docx").select("doc_id", F.lit(None).cast("string").alias("path"), F.lit("docx").alias("format"), "content")
    return rel.headings(src.paragraphs(docx), 2).select("doc_id", F.col("outline_level").cast("long").alias("level"), "text")


def text_to_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files of all documents: signature and whether the end mark stands."""
    pdf = src.convert(src.text_documents(_t(spark, sf_dir, "documents"), "text"), "pdf")
    ok = (F.substring("content", 1, 5) == F.lit(b"%PDF-")) & (F.substring("content", -6, 5) == F.lit(b"%%EOF"))
    return pdf.select("doc_id", ok.alias("ok"), F.col("error").isNull().alias("made"))


def pipe_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe table of each region's nations."""
    n = _t(spark, sf_dir, "nation")
    body = n.select(F.col("n_regionkey").alias("doc_id"), F.dense_rank().over(_w("n_regionkey", "n_nationkey")).alias("row_idx"), F.explode(F.array(F.struct(F.lit(0).alias("col_idx"), F.col("n_name").alias("text")), F.struct(F.lit(1).alias("col_idx"), F.col("n_nationkey").cast("string").alias("text")))).alias("c"))
    body = body.select("doc_id", "row_idx", "c.col_idx", "c.text")
    head = n.select(F.col("n_regionkey").alias("doc_id")).distinct().select("doc_id", F.lit(0).alias("row_idx"), F.explode(F.array(F.struct(F.lit(0).alias("col_idx"), F.lit("name").alias("text")), F.struct(F.lit(1).alias("col_idx"), F.lit("key").alias("text")))).alias("c")).select("doc_id", "row_idx", "c.col_idx", "c.text")
    cells = head.unionByName(body).withColumn("alignment", F.when(F.col("col_idx") == 1, 2).otherwise(0))
    return rel.pipe_tables(cells, ["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _w(by: str, order: str):
    from pyspark.sql import Window as W

    return W.partitionBy(by).orderBy(order)


def html_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "region")
    cells = r.select(F.lit(1).cast("long").alias("doc_id"), F.col("r_regionkey").alias("row_idx"), F.lit(0).alias("col_idx"), F.concat("r_name", F.lit(" & <co>")).alias("text"))
    return rel.html_tables(cells, ["doc_id"])


def list_labels_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as list items: a line of an even number is one level down."""
    li = _t(spark, sf_dir, "lineitem")
    items = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("list_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(0).alias("level"), F.lit(1).alias("start_at"))
    return rel.list_numbers(items).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("number").cast("long").alias("number"))


def list_labels_roman(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey")
    n = F.col("p_partkey").cast("int")
    return p.select("p_partkey", rel.list_label(n, F.lit(1)).alias("upper"), rel.list_label(n, F.lit(2)).alias("lower"), rel.list_label(n, F.lit(3)).alias("letter"))


def join_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a heading for the first turn, quotes for users, paragraphs for the rest."""
    c = _t(spark, sf_dir, "conversations")
    tag = F.when(F.col("turn") == 0, "heading").when(F.col("role") == "user", "quote").otherwise("block")
    b = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), tag.alias("tag"), F.lit(1).alias("level"), F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("text"))
    b = b.groupBy("doc_id", "ord").agg(F.min(F.struct("tag", "level", "text")).alias("s")).select("doc_id", "ord", "s.tag", "s.level", "s.text")
    return rel.joined_blocks(b)


def run_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as runs: those of one return flag that follow each other merge."""
    li = _t(spark, sf_dir, "lineitem")
    r = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("flag"), F.concat(F.col("l_linenumber").cast("string"), F.lit(";")).alias("text"))
    r = r.groupBy("doc_id", "ord").agg(F.min("flag").alias("flag"), F.min("text").alias("text"))
    return rel.merge_runs(r, ["doc_id"], "ord", ["flag"]).select("doc_id", F.col("run").cast("long").alias("run"), "flag", "text")


def visible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as inlines: views start a field, purchases end one."""
    e = _t(spark, sf_dir, "events")
    k = F.col("event_id") % 7
    kind = F.when(k == 1, "field_start").when(k == 3, "field_separator").when(k == 5, "field_end").otherwise("run")
    i = e.select((F.col("user_id") % 50).alias("doc_id"), F.col("event_id").alias("ord"), kind.alias("kind"))
    return rel.visible_runs(i, ["doc_id"], "ord").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character runs against paragraphs, made of part sizes."""
    p = _t(spark, sf_dir, "part")
    doc = (F.col("p_partkey") % 5).alias("doc_id")
    left = p.select(doc, F.col("p_partkey").alias("l_id"), (F.col("p_partkey") * 10).alias("cp_start"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("cp_end"))
    right = p.select(doc, F.col("p_partkey").alias("r_id"), (F.col("p_partkey") * 9).alias("cp_start"), (F.col("p_partkey") * 9 + 25).alias("cp_end"))
    return rel.overlapping(left, right, width=64).select("doc_id", "l_id", "r_id")


def image_intern_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    i = c.select(F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").cast("binary").alias("content"))
    return rel.interned_images(i).select("doc_id", "ord", F.col("number").cast("long").alias("number"))


def md_repeated_links_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations that an order's lines use more than once, numbered by first use."""
    li = _t(spark, sf_dir, "lineitem")
    links = li.select((F.col("l_orderkey") % 100).alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("<http://s.example/"), F.col("l_suppkey").cast("string"), F.lit(">")).alias("destination"))
    return rel.link_references(links).select("doc_id", F.col("key").alias("destination"), F.col("uses"), F.col("number").cast("long").alias("number"))


def color_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    c = F.when(k % 2 == 0, F.concat(F.lit("Color [A=255, R="), (k % 256).cast("string"), F.lit(", G="), (k % 7).cast("string"), F.lit(", B=9]"))).otherwise(F.lower(F.lpad(F.hex(k), 6, "0")))
    return p.select("p_partkey", tx.color_rgb(c).alias("rgb"))


def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    return p.select("p_partkey", *[F.round(tx.points(F.col("s"), u), 6).alias(u) for u in ("twip", "half_point", "eighth", "mm", "pixel")])


def tab_stop_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tab stop before and the first after a place, of stops of which one is cleared, one removed and one added."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("s"))
    stop = lambda x: F.struct(F.lit(x).alias("position"), F.lit(0).alias("alignment"), F.lit(0).alias("leader"), F.lit(x == 20).alias("is_clear"))
    stops = st.remove_tab_stop(F.array(*map(stop, (5, 12, 20, 33, 40))), F.lit(40))
    stops = st.add_tab_stop(stops, F.lit(47), F.lit(0), F.lit(0))
    found = p.select("p_partkey", st.tab_stop_before(stops, F.col("s"))["position"].alias("b"), st.tab_stop_after(stops, F.col("s"))["position"].alias("a"))
    return found.select("p_partkey", F.coalesce("b", F.lit(-1)).cast("long").alias("before"), F.coalesce("a", F.lit(-1)).cast("long").alias("after"))


def style_names_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style names made of part keys, and what they say."""
    p = _t(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("Heading "), (k % 11).cast("string"))).when(k % 5 == 1, F.concat(F.lit("Quote"), (k % 4).cast("string"))).when(k % 5 == 2, F.lit("FencedCode.python")).when(k % 5 == 3, F.lit("List Paragraph")).otherwise(F.lit("IndentedCode"))
    s = st.parsed_style(name)
    return p.select("p_partkey", *[s[c].cast("long").alias(c) for c in ("heading_level", "quote_level")], s["code_type"].alias("code_type"), s["code_language"].alias("code_language"), s["is_list_paragraph"].alias("is_list"))


def list_items_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    level = F.col("n_nationkey") % 4
    return n.select("n_nationkey", st.list_item(F.col("n_name"), level, st.bullet_marker(level)).alias("item"))


def conditional_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", F.conv(F.col("p_partkey").cast("string"), 10, 2).alias("b"))
    m = st.mask_from(F.right(F.col("b"), F.lit(12)))
    return p.select("p_partkey", st.mask_to(m).alias("mask"), m["last_row"].alias("last_row"))


def corpus_block_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("lang", "source", F.size(tx.split_lines(F.col("text"))).cast("long").alias("n"))
    return d.cube("lang", "source").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_docs"))


def _suppliers_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document of each supplier, with constructs of every kind."""
    s = _t(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey").cast("string"))
    text = F.concat(
        F.lit("Title "), "k", F.lit("\n=====\n\nSee `code "), "k", F.lit("` and ``a`b`` and <http://x.example/"), "k", F.lit("> and [Text][ref "), "k",
        F.lit("] and a note[^n].\n\n> quoted "), "k", F.lit("\n> > deeper\n\n3. three\n4. four\n   - inner *it* **bo** ~~st~~\n\n```py\nx = "), "k",
        F.lit("\n```\n\n    indented\n\n---\n\nSub\n---\n\n[REF  "), "k", F.lit("]: http://r.example/"), "k", F.lit(' "T"\n[ref '), "k", F.lit("]: http://second.example/\n\n[^n]: Body "), "k", F.lit(" of it\n"),
    )
    return src.text_documents(s.select(F.col("s_suppkey").alias("doc_id"), text.alias("text")), "markdown")


def md_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of those documents: style, level and text, in order."""
    p = src.paragraphs(_suppliers_md(spark, sf_dir))
    return p.select("doc_id", "style_name", F.coalesce("outline_level", F.lit(-1)).cast("long").alias("outline"), F.coalesce(F.when(F.col("list_id").isNotNull(), F.col("level")), F.lit(-1)).cast("long").alias("level"), "text")


def md_inline_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of those documents that carry a mark."""
    i = src.inlines(_suppliers_md(spark, sf_dir)).where("bold or italic or strike or superscript")
    return i.select("doc_id", "text", "bold", "italic", "strike", "superscript")


def md_roundtrip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents written as Markdown, read again: the same paragraphs."""
    again = src.convert(_suppliers_md(spark, sf_dir), "markdown").select("doc_id", F.lit(None).cast("string").alias("path"), F.lit("markdown").alias("format"), "content")
    return src.paragraphs(again).select("doc_id", "style_name", "text")


_CONSTRUCTS = """
    SELECT s_suppkey AS doc_id, unnest([
        {'s': 'SetextHeading1', 'o': 0, 'l': -1, 't': 'Title ' || k},
        {'s': 'Normal', 'o': -1, 'l': -1, 't': 'See code ' || k || ' and a`b and [http://x.example/' || k || '](http://x.example/' || k || ') and [Text](http://r.example/' || k || ' "T") and a note[^1].'},
        {'s': 'Quote', 'o': -1, 'l': -1, 't': 'quoted ' || k}, {'s': 'Quote1', 'o': -1, 'l': -1, 't': 'deeper'},
        {'s': 'Normal', 'o': -1, 'l': 0, 't': 'three'}, {'s': 'Normal', 'o': -1, 'l': 0, 't': 'four'}, {'s': 'Normal', 'o': -1, 'l': 1, 't': 'inner it bo st'},
        {'s': 'FencedCode.py', 'o': -1, 'l': -1, 't': 'x = ' || k}, {'s': 'IndentedCode', 'o': -1, 'l': -1, 't': 'indented'}, {'s': 'HorizontalRule', 'o': -1, 'l': -1, 't': ''},
        {'s': 'SetextHeading2', 'o': 1, 'l': -1, 't': 'Sub'}, {'s': 'Footnote Text', 'o': -1, 'l': -1, 't': '[^1]: Body ' || k || ' of it'}]) AS r FROM (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS k FROM supplier)"""

_SQL = {
    "md_constructs": f"SELECT doc_id, r.s AS style_name, CAST(r.o AS BIGINT) AS outline, CAST(r.l AS BIGINT) AS level, r.t AS text FROM ({_CONSTRUCTS})",
    "md_inline_marks": "SELECT s_suppkey AS doc_id, r.t AS text, r.b AS bold, r.i AS italic, r.s AS strike, r.u AS superscript FROM (SELECT s_suppkey, unnest([{'t': '[^1]', 'b': false, 'i': false, 's': false, 'u': true}, {'t': '[^1]: ', 'b': false, 'i': false, 's': false, 'u': true}, {'t': 'it', 'b': false, 'i': true, 's': false, 'u': false}, {'t': 'bo', 'b': true, 'i': false, 's': false, 'u': false}, {'t': 'st', 'b': false, 'i': false, 's': true, 'u': false}]) AS r FROM supplier)",
    "md_roundtrip_text": f"SELECT doc_id, r.s AS style_name, r.t AS text FROM ({_CONSTRUCTS})",
    "text_stats_by_lang": f"SELECT lang, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_paragraphs, (SELECT CAST(sum(length(d.text)) AS BIGINT) FROM documents d WHERE d.lang = p.lang) AS n_chars FROM {_LINES} p GROUP BY lang",
    "text_paragraphs": f"SELECT doc_id, CAST(ord AS BIGINT) AS ord, text FROM {_LINES}",
    "get_text": f"SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS text FROM {_LINES} WHERE text <> '' GROUP BY doc_id",
    "line_block_kinds": rf"""
        SELECT kind, count(*) AS n FROM (SELECT CASE
            WHEN regexp_matches(text, '^\s*$') THEN 'blank'
            WHEN regexp_matches(text, '^ {{0,3}}(`{{3,}}[^`]*|~{{3,}}.*)$') THEN 'fence'
            WHEN regexp_matches(text, '^ {{0,3}}#{{1,6}}([ \t]|$)') THEN 'heading'
            WHEN regexp_matches(text, '^ {{0,3}}((\*[ \t]*){{3,}}|(-[ \t]*){{3,}}|(_[ \t]*){{3,}})$') THEN 'rule'
            WHEN contains(text, '|') AND contains(nxt, '|') AND regexp_matches(nxt, '^ {{0,3}}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$') THEN 'table'
            WHEN regexp_matches(text, '^ {{0,3}}>') THEN 'quote'
            WHEN regexp_matches(text, '^ {{0,3}}[-+*]([ \t]|$)') THEN 'bullet'
            WHEN regexp_matches(text, '^ {{0,3}}[0-9]{{1,9}}[.)]([ \t]|$)') THEN 'ordered'
            WHEN regexp_matches(text, '^( {{4}}|\t)') THEN 'code'
            WHEN regexp_matches(nxt, '^ {{0,3}}(=+|-+)[ \t]*$') THEN 'setext' ELSE 'text' END AS kind
        FROM (SELECT text, coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY ord), '') AS nxt FROM {_LINES})) GROUP BY kind""",
    "detect_format": "SELECT CASE c_custkey % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.doc' WHEN 2 THEN '.rtf' ELSE '.txt' END AS suffix, count(*) AS n FROM customer GROUP BY 1",
    "escape_markdown": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7f]', 'x', 'g'), '\*', '\\*', 'g'), '([^0-9A-Za-z_])(_)', '\1\\_', 'g'), '^_', '\\_'), '([^\\])_([^0-9A-Za-z_]|$)', '\1\\_\2', 'g') AS text FROM documents""",
    "xml_escape": r"""SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml FROM pages""",
    "safe_text_latin1": "SELECT doc_id, regexp_replace(replace(text, chr(160), ' '), '[^\\x00-\\x{FF}]', '?', 'g') || '??" + SPELT.replace("'", "''") + "' AS text FROM documents",
    "html_blocks_from_pages": r"""
        WITH b AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(html, '(?i)</?(?:p|div|table|tr|td|th|h[1-6]|br)\s*/?>'), lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;?', '''', 'g'), '&apos;', '''', 'g'), '&nbsp;?', chr(160), 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM pages)
        SELECT page_id, CAST(unnest(range(len(l))) AS BIGINT) AS ord, unnest(l) AS text FROM b""",
    "html_references": "SELECT p_partkey, 'éé\u00e9…&lt;¬it;\u2019&unknown; ' || p_partkey || chr(CAST(64 + p_partkey % 26 AS INT)) || '<&#65;' || chr(160) || '&' AS text FROM part",
    "md_headings_from_nations": "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS level, r_name AS text FROM region UNION ALL SELECT n_regionkey, 1, n_name FROM nation",
    "md_emphasis_runs": "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, count(*) AS n_bold, CAST(sum(length(n_name)) AS BIGINT) AS n_chars FROM nation GROUP BY 1",
    "md_list_items": "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(2 * count(*) AS BIGINT) AS n_items, count(*) AS n_lists FROM nation GROUP BY 1",
    "md_table_cells_orders": "SELECT o_custkey AS doc_id, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS sum_keys FROM orders GROUP BY 1",
    "text_to_pdf": "SELECT doc_id, true AS ok, true AS made FROM documents",
    "pipe_table_render": """
        WITH w AS (SELECT n_regionkey AS d, CAST(greatest(4, max(length(n_name))) AS INT) AS a, CAST(greatest(3, max(length(n_nationkey::VARCHAR))) AS INT) AS b FROM nation GROUP BY 1)
        SELECT CAST(d AS BIGINT) AS doc_id, '| ' || rpad('name', a, ' ') || ' | ' || rpad('key', b, ' ') || ' |' || chr(10) || '| ' || repeat('-', a) || ' | ' || repeat('-', b - 1) || ': |' || chr(10)
            || string_agg('| ' || rpad(n_name, a, ' ') || ' | ' || rpad(n_nationkey::VARCHAR, b, ' ') || ' |', chr(10) ORDER BY n_nationkey) AS text
        FROM w JOIN nation ON n_regionkey = d GROUP BY d, a, b""",
    "html_table_render": "SELECT CAST(1 AS BIGINT) AS doc_id, '<table>' || string_agg('<tr><' || t || '>' || r_name || ' &amp; &lt;co&gt;</' || t || '></tr>', '' ORDER BY r_regionkey) || '</table>' AS text FROM (SELECT *, CASE WHEN r_regionkey = 0 THEN 'th' ELSE 'td' END AS t FROM region)",
    "list_labels_running": "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS ord, CAST(CASE WHEN l_linenumber % 2 = 0 THEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2, above ORDER BY l_linenumber) ELSE row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber) END AS BIGINT) AS number FROM (SELECT *, sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS above FROM lineitem)",
    "list_labels_roman": """
        WITH r AS (SELECT p_partkey AS n, repeat('M', CAST(p_partkey // 1000 AS INT)) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[p_partkey // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[p_partkey // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[p_partkey % 10 + 1] AS u FROM part),
        b AS (SELECT n, u, (n - 1) // 26 AS n2, ((n - 1) // 26 - 1) // 26 AS n3, (((n - 1) // 26 - 1) // 26 - 1) // 26 AS n4 FROM r)
        SELECT n AS p_partkey, u AS upper, lower(u) AS lower, CASE WHEN n > 18278 THEN chr(CAST(65 + (n4 - 1) % 26 AS INT)) ELSE '' END || CASE WHEN n > 702 THEN chr(CAST(65 + (n3 - 1) % 26 AS INT)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + (n2 - 1) % 26 AS INT)) ELSE '' END || CASE WHEN n > 0 THEN chr(CAST(65 + (n - 1) % 26 AS INT)) ELSE '' END AS letter FROM b""",
    "join_blocks": """
        WITH b AS (SELECT conv_id AS doc_id, turn AS ord, min({'tag': CASE WHEN turn = 0 THEN 'heading' WHEN role = 'user' THEN 'quote' ELSE 'block' END, 'text': role || ':' || length(text)::VARCHAR}) AS s FROM conversations GROUP BY 1, 2),
        l AS (SELECT doc_id, ord, s.tag AS tag, s.text AS text, lag(s.tag) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM b)
        SELECT doc_id, string_agg(CASE WHEN prev IS NULL THEN '' WHEN tag = 'heading' OR prev = 'heading' THEN chr(10) WHEN tag = 'quote' AND prev = 'quote' THEN chr(10) || '>' || chr(10) ELSE chr(10) || chr(10) END || text, '' ORDER BY ord) || chr(10) AS text FROM l GROUP BY doc_id""",
    "run_merge_islands": "WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2), m AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY doc_id ORDER BY ord) THEN 1 ELSE 0 END AS c FROM r), i AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM m) SELECT doc_id, CAST(run AS BIGINT) AS run, flag, string_agg(ord::VARCHAR || ';', '' ORDER BY ord) AS text FROM i GROUP BY doc_id, run, flag",
    "visible_runs": "WITH i AS (SELECT user_id % 50 AS doc_id, event_id AS ord, CASE event_id % 7 WHEN 1 THEN 1 WHEN 3 THEN -1 WHEN 5 THEN -1 ELSE 0 END AS d, event_id % 7 IN (1, 3, 5) AS f FROM events), s AS (SELECT *, sum(d) OVER (PARTITION BY doc_id ORDER BY ord) AS s FROM i), t AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY ord)) AS depth FROM s) SELECT doc_id, count(*) AS n, min(ord) AS first FROM t WHERE NOT f AND depth = 0 GROUP BY doc_id",
    "interval_overlap_join": "SELECT l.p_partkey % 5 AS doc_id, l.p_partkey AS l_id, r.p_partkey AS r_id FROM part l JOIN part r ON l.p_partkey % 5 = r.p_partkey % 5 AND l.p_partkey * 10 < r.p_partkey * 9 + 25 AND r.p_partkey * 9 < l.p_partkey * 10 + l.p_size WHERE l.p_size > 0",
    "image_intern_dedupe": "WITH f AS (SELECT c_nationkey AS n, c_mktsegment AS s, min(c_custkey) AS first FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY first) AS number FROM f) SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS ord, number FROM customer JOIN r ON n = c_nationkey AND s = c_mktsegment",
    "md_repeated_links_having": "WITH u AS (SELECT l_orderkey % 100 AS doc_id, 'http://s.example/' || l_suppkey AS destination, count(*) AS uses, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) SELECT doc_id, destination, uses, row_number() OVER (PARTITION BY doc_id ORDER BY f, destination) AS number FROM u",
    "color_parse": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN printf('%02X%02X%02X', CAST(p_partkey % 256 AS INT), CAST(p_partkey % 7 AS INT), 9) ELSE printf('%06X', CAST(p_partkey AS INT)) END AS rgb FROM part",
    "unit_conversions": "SELECT p_partkey, round(p_size::DOUBLE * 0.05, 6) AS twip, round(p_size::DOUBLE * 0.5, 6) AS half_point, round(p_size::DOUBLE * 0.125, 6) AS eighth, round(p_size::DOUBLE * (72 / 25.4::DOUBLE), 6) AS mm, round(p_size::DOUBLE * 0.75, 6) AS pixel FROM part",
    "tab_stop_asof": "SELECT p_partkey, CAST(coalesce(list_max(list_filter([5, 12, 33, 47], lambda x: x < p_size)), -1) AS BIGINT) AS before, CAST(coalesce(list_min(list_filter([5, 12, 33, 47], lambda x: x > p_size)), -1) AS BIGINT) AS after FROM part",
    "style_names_parsed": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 = 0 THEN least(6, p_partkey % 11) ELSE 0 END AS BIGINT) AS heading_level, CAST(CASE WHEN p_partkey % 5 = 1 THEN p_partkey % 4 ELSE 0 END AS BIGINT) AS quote_level, CASE p_partkey % 5 WHEN 2 THEN 'fenced' WHEN 4 THEN 'indented' ELSE '' END AS code_type, CASE p_partkey % 5 WHEN 2 THEN 'python' ELSE '' END AS code_language, p_partkey % 5 = 3 AS is_list FROM part",
    "list_items_formatted": "SELECT n_nationkey, repeat('  ', n_nationkey % 4) || (['-', 'o', '+', '+'])[n_nationkey % 4 + 1] || ' ' || n_name AS item FROM nation",
    "conditional_masks": "SELECT p_partkey, rpad(right(bin(p_partkey), 12), 12, '0') AS mask, substr(rpad(right(bin(p_partkey), 12), 12, '0'), 2, 1) = '1' AS last_row FROM part",
    "corpus_block_cube": f"WITH d AS (SELECT d.doc_id, any_value(d.lang) AS lang, any_value(d.source) AS source, count(p.ord) AS n FROM documents d LEFT JOIN {_LINES} p ON p.doc_id = d.doc_id GROUP BY d.doc_id) SELECT lang, source, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS n_docs FROM d GROUP BY CUBE (lang, source)",
}
_SQL["md_to_docx_roundtrip"] = _SQL["md_headings_from_nations"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (text_stats_by_lang, text_paragraphs, get_text, line_block_kinds, detect_format, escape_markdown, xml_escape, safe_text_latin1, html_blocks_from_pages, html_references, md_headings_from_nations, md_emphasis_runs, md_list_items, md_table_cells_orders, md_to_docx_roundtrip, text_to_pdf, pipe_table_render, html_table_render, list_labels_running, list_labels_roman, join_blocks, run_merge_islands, visible_runs, interval_overlap_join, image_intern_dedupe, md_repeated_links_having, color_parse, unit_conversions, tab_stop_asof, style_names_parsed, list_items_formatted, conditional_masks, corpus_block_cube, md_constructs, md_inline_marks, md_roundtrip_text)
    return {f.__name__: f for f in found} | structure.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | structure.oracle_sql()
