"""Readers, writers and relational operators of the document engine."""

import base64
import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliant.functions import formats, text
from foliant.functions.docx import DocxWriter, read_docx, write_docx
from foliant.functions.markdown import read_markdown, read_text
from foliant.functions.markdown_out import MarkdownWriter, write_markdown
from foliant.functions.model import Font, Inline, Paragraph, paragraph_rows
from foliant.functions.pdf import write_pdf
from foliant.operators import relational as rel
from foliant.sources import documents as src
from foliant.streaming.files import stream_paragraphs

SOURCE = """# Heading 1
This is a **bold** and *italic* paragraph.
## Heading 2
- Item 1
- Item 2
- Item 3

Some `inline code` and a [link](https://example.com).

```python
def hello():
    print("world")
```
"""


def test_markdown_rows():
    rows = paragraph_rows(read_markdown(SOURCE))
    assert [(r["style_name"], r["outline_level"], r["level"], r["text"]) for r in rows] == [
        ("Heading 1", 0, None, "Heading 1"),
        ("Normal", None, None, "This is a bold and italic paragraph."),
        ("Heading 2", 1, None, "Heading 2"),
        ("Normal", None, 0, "Item 1"),
        ("Normal", None, 0, "Item 2"),
        ("Normal", None, 0, "Item 3"),
        ("Normal", None, None, "Some inline code and a [link](https://example.com)."),
        ("FencedCode.python", None, None, 'def hello():\n    print("world")'),
    ]
    assert write_markdown(read_markdown(SOURCE)) == SOURCE


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("", []),
        ("a\nb  \nc\\\nd", ["a b\nc\nd"]),
        ("1. x\n   y\n\n   z\n2. w", ["x y", "z", "w"]),
        ("> a\nlazy\n\nb", ["a lazy", "b"]),
        ("[x]: /u 'T'\n[x]: /v\n\n[x] [X][] [t][x] [none]", ['[x](/u "T") [X](/u "T") [t](/u "T") [none]']),
        ("a[^n] b[^n]\n\n[^n]: note", ["a[^1] b[^2]", "[^1]: note", "[^2]: note"]),
        ("&amp; \\* <http://a.b> <x@y.z>", ["& * [http://a.b](http://a.b) [x@y.z](mailto:x@y.z)"]),
        ("| a | b |\n|---|---|\n| 1 |\n| 2 | 3 | 4 |", ["a", "b", "1", "", "2", "3"]),
        ("Set\n---\n***\n    code\n", ["Set", "", "code"]),
        ("<div>one<p>two</p></div>", ["one", "two"]),
        ("*a **b** c* ***d***", ["a b c d"]),
        ("snake_case_word 2*3*4", ["snake_case_word 234"]),
    ],
)
def test_markdown_texts(source, texts):
    assert [r["text"] for r in paragraph_rows(read_markdown(source))] == texts


def test_markdown_empty_lines():
    d = read_markdown("# Title\n\n\nParagraph after two blank lines.\n", keep_empty=True)
    assert [b.text for b in d.blocks] == ["Title", "", "Paragraph after two blank lines."]


def test_emphasis_nests():
    fonts = [(i.text, i.font.bold, i.font.italic) for i in read_markdown("*a **b** c*").blocks[0].inlines]
    assert fonts == [("a ", False, True), ("b", True, True), (" c", False, True)]


@pytest.mark.parametrize("source", [SOURCE, "> a\n>\n> > b\n", "- a\n  - b\n    1. c\n- d\n", "~~x~~ **y *z***\n", "1\\. no list\n", "\\# no heading\n", "| a   | b\\|c |\n| :-: | ----: |\n| 1   |     2 |\n"])
def test_markdown_is_stable(source):
    once = write_markdown(read_markdown(source))
    assert write_markdown(read_markdown(once)) == once
    assert [r["text"] for r in paragraph_rows(read_markdown(once))] == [r["text"] for r in paragraph_rows(read_markdown(source))]


def test_links_by_reference():
    d = read_markdown("[a](http://x) [b](http://y)\n\n[c](http://x)")
    assert write_markdown(d, links="auto") == "[a][1] [b](http://y)\n\n[c][1]\n\n[1]: http://x\n"
    assert "[b][2]" in write_markdown(d, links="reference")


def png(w=64, h=32):
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def test_docx_round_trip():
    image = base64.b64encode(png()).decode()
    d = read_markdown(SOURCE + f"\n![alt](data:image/png;base64,{image}) ![again](data:image/png;base64,{image})\n\n| a | b |\n|---|--:|\n| 1 | 2 |\n\n[x](http://l \"t\") and [in](#name)\n")
    data = write_docx(d)
    back = read_docx(data)
    assert back.text == d.text and write_markdown(back) == write_markdown(d)
    z = zipfile.ZipFile(io.BytesIO(data))
    assert [n for n in z.namelist() if "media" in n] == ["word/media/image1.png"]
    xml = z.read("word/document.xml").decode()
    assert xml.count("<w:hyperlink ") == 3 and 'w:anchor="name"' in xml
    assert write_docx(d) == data


def test_docx_details():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    body = '<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:sdt><w:sdtContent><w:p><w:r><w:rPr><w:b/><w:i w:val="0"/><w:u w:val="single"/></w:rPr><w:t>in</w:t><w:tab/><w:t>side</w:t></w:r></w:p></w:sdtContent></w:sdt><w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="B"><w:name w:val="heading 2"/></w:style><w:style w:styleId="H"><w:name w:val="Mine"/><w:basedOn w:val="B"/></w:style><w:style w:styleId="C1"><w:basedOn w:val="C1"/></w:style></w:styles>')
    d = read_docx(out.getvalue())
    assert [(p.style, p.text) for p in d.blocks] == [("Mine", "Top"), ("Normal", "in\tside"), ("Normal", "PAGE7")]
    assert d.blocks[1].inlines[0].font == Font(bold=True, underline=True)
    assert write_markdown(d) == "Top\n\n**in\tside**\n\n7\n"


def test_pdf():
    d = read_markdown(SOURCE + "\n[a](http://x) ünïcode 中 (brackets\\)\n\n" + "word " * 3000)
    data = write_pdf(d, compress=False)
    assert data.startswith(b"%PDF-1.7") and data.endswith(b"%%EOF\n")
    assert data.count(b"/Type /Page /Parent") > 1 and data.count(b"/Subtype /Link") == 2 and b"/Type /Outlines" in data
    at = int(data.split(b"startxref\n")[1].split()[0])
    assert data[at : at + 4] == b"xref"
    assert write_pdf(read_text("")).startswith(b"%PDF")


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text(SOURCE)
    (tmp_path / "b.txt").write_text("one\n\ntwo\x0bthree")
    (tmp_path / "c.docx").write_bytes(write_docx(read_markdown("# T\n\nx")))
    (tmp_path / "d.docx").write_bytes(b"broken")
    raw = src.read_documents(spark, str(tmp_path))
    p = src.paragraphs(raw)
    assert {r.doc_id.rpartition("/")[2]: r.n for r in p.groupBy("doc_id").agg(F.sum(F.col("text").isNotNull().cast("int")).alias("n")).collect()} == {"a.md": 8, "b.txt": 4, "c.docx": 2, "d.docx": 0}
    assert p.where("error is not null").count() == 1
    assert {r.text for r in rel.document_text(p.where("error is null")).collect()} >= {"one\ntwo\nthree", "T\nx"}
    out = src.write_files(src.convert(raw, "markdown"), str(tmp_path / "out"), ".md").collect()
    assert len(out) == 3
    with pytest.raises(src.UnsupportedFormat):
        src.convert(raw, "doc")
    assert {r.number_style for r in src.list_levels(raw.where("path like '%.md'")).collect()} == {23}
    assert src.styles(raw.where("path like '%.md'")).count() >= 3


def test_every_row_has_its_file(spark, tmp_path):
    ids = ["in/a/b.md", "in/a_b.md", "x y", "x_y", "1/" + "d" * 130, "2/" + "d" * 130, "twice", "twice", "twice", None, None, "None", "ü" * 200]
    rows = [(x, str(k % 8).encode()) for k, x in enumerate(ids)]
    out = src.write_files(spark.createDataFrame(rows, "doc_id string, content binary").repartition(3), str(tmp_path / "out"), ".md").collect()
    found = [(r.doc_id, (tmp_path / "out" / r.file).read_bytes()) for r in out]
    assert sorted(map(repr, found)) == sorted(map(repr, rows)) and len({r.file for r in out}) == len(rows) == len(list((tmp_path / "out").iterdir()))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\nx")
    q = stream_paragraphs(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("paras").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert sorted(r.text for r in spark.sql("select text from paras").collect()) == ["T", "x"]
    finally:
        q.stop()


def test_formats(spark):
    rows = [("a.DOCX", b"x", None), ("a", b"PK\x03\x04", None), ("a", b"{\\rtf", None), (None, b"hi", None), ("a.md", b"", 62), ("a.bin", b"", None), ("x.markdown", b"", None)]
    df = spark.createDataFrame(rows, "path string, content binary, explicit int")
    got = [r[0] for r in df.select(formats.reader_of(F.col("path"), F.col("content"), F.col("explicit"))).collect()]
    assert got == ["docx", "docx", "rtf", "text", "text", "docx", "markdown"]
    one = spark.createDataFrame([("Markdown", png())], "f string, i binary").select(formats.load_format(F.col("f")).alias("f"), formats.image_size(F.col("i")).alias("s")).first()
    assert one.f == 63 and tuple(one.s) == (48.0, 24.0)


def test_text_functions(spark):
    t = "a\r\nb\x0bc d\n\n"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(text.split_lines(F.col("t"))).first()[0] == t.splitlines()
    breaks = ["", "\n", "\r\n", "a\r", "a\r\n", "\n\r", "a\x85", "\u2028", None, "a\n\r\n"]
    rows = spark.createDataFrame([(x,) for x in breaks], "t string").select("t", text.split_lines(F.col("t")).alias("l"), F.col("t").rlike(text.NOT_BREAK).alias("some")).collect()
    assert all(r.l == (None if r.t is None else r.t.splitlines()) and r.some == (None if r.t is None else any(r.l)) for r in rows)
    page = "<P>&eacute;&#233;&amp;lt;</p><p class=x>&notit; &#0;\0</div> &nbsp; <br/>tail&amp"
    rows = spark.createDataFrame([(page,), (None,), ("",)], "t string").select(text.html_blocks(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["éé&lt;", "¬it; \ufffd\ufffd", "tail&"], None, []]
    row = lambda s, c: spark.createDataFrame([(s,)], "t string").select(c(F.col("t"))).first()[0]
    assert row("a*b_ c_d", text.escape_emphasis) == "a\\*b\\_ c_d"
    assert row("` x", text.inline_code) == "`` ` x ``"
    assert row("```\nx", text.code_fence) == "````"
    assert row("x\n", lambda c: text.quote_lines(c, 2)) == "> > x\n> > "
    assert row("  x\n    y", text.wrap_leading_blanks) == "`  `x\n    y"


def test_list_levels_and_references(spark):
    items = spark.createDataFrame([(1, 5, 0), (1, 5, 3)], "doc_id long, list_id int, level int")
    levels = spark.createDataFrame([(1, 5, 0, 0, "%1.", 1), (1, 5, 1, 2, "%2)", 4)], "doc_id long, list_id int, level int, number_style int, number_format string, start_at int")
    over = spark.createDataFrame([(1, 5, 3, 9, None)], "doc_id long, list_id int, ilvl int, start_at int, level_override struct<number_style:int,number_format:string,start_at:int>")
    got = {r.level: (r.number_style, r.number_format, r.start_at) for r in rel.resolve_levels(items, levels, over).collect()}
    assert got == {0: (0, "%1.", 1), 3: (2, "%2)", 9)}
    refs = rel.resolve_references(spark.createDataFrame([(1, "x  Y"), (1, "z")], "doc_id long, label string"), spark.createDataFrame([(1, 0, "X y", "u", ""), (1, 1, "x y", "v", "")], "doc_id long, ord int, label string, uri string, title string"))
    assert {r.label: r.uri for r in refs.collect()} == {"x  Y": "u", "z": None}


def test_model_merges_runs():
    p = Paragraph()
    p.add("a", Font())
    p.add("b", Font())
    p.add("c", Font(bold=True))
    p.inlines.append(Inline("bookmark_start", title="m"))
    assert [i.text for i in p.inlines] == ["ab", "c", ""]


def test_catalog_has_sql():
    from foliant.plans import catalog

    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize(
    "source",
    [
        "para\n\nTitle\n=====\n\nafter\n",
        "- a\n\n  b\n- c\n",
        "x[^a]\n\n[^a]: first\n\n    second\n",
        "---\n---\n\ntext\n",
        "> one\n> > two\n\ntext\n",
    ],
)
def test_blocks_stay_apart_when_written(source):
    """Writing and reading again gives the same paragraphs, of the same styles."""
    first = [(r["style_name"], r["text"]) for r in paragraph_rows(read_markdown(source))]
    again = [(r["style_name"], r["text"]) for r in paragraph_rows(read_markdown(MarkdownWriter().write(read_markdown(source))))]
    assert again == first and len(first) > 1


def test_style_ids_are_unique():
    names = ["My Style", "MyStyle", "My  Style", "标题", "正文", "Normal", ""]
    w = DocxWriter()
    w.style_ids = {}
    ids = [w.style_id(n) for n in names]
    assert ids[:5] == ["MyStyle", "MyStyle0", "MyStyle_2", "标题", "正文"] and ids[5] == ids[6] == "Normal" and w.style_id("MyStyle") == "MyStyle0"


def test_numerals(spark):
    rows = spark.createDataFrame([(n,) for n in (-1, 0, 1, 4, 26, 27, 52, 53, 702, 703, 3999, 4000, 18279)], "n int").select("n", text.roman(F.col("n")).alias("r"), text.alphabetic(F.col("n")).alias("a")).collect()
    assert all((r.r, r.a) == (text.roman_numeral(r.n), text.letters(r.n)) for r in rows)
    assert {r.n: (r.r, r.a) for r in rows}[27] == ("XXVII", "AA") and {r.n: r.a for r in rows}[53] == "BA" and {r.n: r.r for r in rows}[4000] == "MMMM" and {r.n: (r.r, r.a) for r in rows}[0] == ("", "")


def test_image_sizes(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF" + bytes(10) + b"\xff\xc0\x00\x11\x08\x00\x20\x00\x40\x03" + bytes(20)
    got = spark.createDataFrame([(1, jpeg), (2, b"GIF89a\x08\x00\x04\x00"), (3, b"x"), (4, None)], "k int, c binary").select("k", formats.image_size(F.col("c")).alias("s")).orderBy("k").collect()
    assert [(r.s.width, r.s.height) if r.s else None for r in got] == [(48.0, 24.0), (6.0, 3.0), None, None]


def test_parsing_is_spread(spark):
    """Rows that come as one task, as those of a small table do, are parsed and written by several."""
    one = src.text_documents(spark.range(64).coalesce(1).selectExpr("id AS doc_id", "concat('# h\n\n', id) AS text"), "markdown")
    parsed, made = src.paragraphs(one), src.convert(one, "pdf")
    for df in (parsed, made):
        tasks = df.select("doc_id", F.spark_partition_id().alias("task")).distinct().collect()
        assert {x.doc_id for x in tasks} == set(range(64)) and len({x.task for x in tasks}) == 4
