"""The relational block reader against the reader that walks through each text, on random lines."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions.markdown import BlockParser
from foliant.operators import running
from foliant.operators.markdown_blocks import cut_columns, markdown_blocks

PIECES = [
    "text", "more words", "", "  ", "# Head", "## Two ##", "#", "### ###", "---", "***", "=====", "```", "```py", "````", "~~~~ x", "~~~", "    code", "\tcode", "  \ttab", "> quote", ">", "> > deep", ">lazy", "- item", "- ", "-", "* star", "+ plus",
    "1. one", "2) two", "10. ten", "   - in", "  lazy", "      deep code", "| a | b |", "|---|:-:|", "a | b", "| c \\| d |", "<div>", "</DIV>", "[a]: http://x", "[a]:", '[b]: <u v> "t"', "[c]: u 'two", "lines'", "[^n]: note", "[^n]: ", "    of it", "> - q item",
    "> ```", "- > iq", "-     five", "-\ttab", "1.  # h", "  1. sub", "     cont", "\t- tab", "  continued para", "- ```", "- - - x", "* * *", " ", "a b",
]


def walked(blocks):
    out = []
    for b in blocks:
        if b.kind == "list":
            out += [("item", "", b.level, b.info, walked(c.children)) for c in b.children]
        elif b.kind == "quote":
            out.append(("quote", "", 0, "", walked(b.children)))
        elif b.kind == "table":
            out.append(("table", "\n".join("\t".join(r) for r in b.rows), 0, "", []))
        else:
            out.append(("setext", b.text, b.level, "", []) if b.info == "setext" and b.kind == "heading" else (b.kind, b.text, b.level, b.info, []))
    return out


def tree(rows):
    """Nested as the walk gives them; definitions and footnotes are no blocks there, and rows of a table have as many cells as its head."""
    top = []
    at = {(): top}
    for r in sorted(rows, key=lambda r: r.path):
        kids = at[tuple(r.path)] = []
        text = r.text
        if r.kind == "table":
            cells = [x.split("\t") for x in text.split("\n")]
            text = "\n".join("\t".join((x + [""] * len(cells[0]))[: len(cells[0])]) for x in cells)
        if r.kind not in ("definition", "footnote"):
            at[tuple(r.path[:-1])].append((r.kind, text, r.level, r.info, kids))
    return top


@pytest.mark.parametrize(("hot", "seed", "n", "most"), [(running.HOT_ROWS, 5, 150, 9), (3, 6, 4, 6)])
def test_blocks_as_a_walk_finds_them(spark, hot, seed, n, most):
    r = random.Random(seed)
    some = PIECES if hot > n else [p for p in PIECES if p.strip()[:1] not in list(">-*+12[")]  # one round is enough to see keys split
    docs = [[r.choice(some) for _ in range(r.randint(1, most))] for _ in range(n)]
    rows = [(d, 2 * o, t, "x") for d, lines in enumerate(docs) for o, t in enumerate(lines)] + [(None, 0, "# lost", "x")]
    found = {}
    for x in markdown_blocks(spark.createDataFrame(rows, "doc_id int, ord int, text string, kind string").repartition(3), hot_rows=hot).collect():
        found.setdefault(x.doc_id, []).append(x)
    assert None not in found
    for d, lines in enumerate(docs):
        assert tree(found.get(d, [])) == walked(BlockParser().parse(lines)), lines


def test_no_lines(spark):
    none = spark.createDataFrame([], "doc_id long, ord int, text string")
    assert markdown_blocks(none).count() == 0 and markdown_blocks(none).columns == ["doc_id", "path", "kind", "text", "level", "info"]
    blank = spark.createDataFrame([(1, 0, None), (1, 1, "")], "doc_id long, ord int, text string")
    assert markdown_blocks(blank).count() == 0


def test_cut_columns(spark):
    rows = spark.createDataFrame([(x, n) for x in ("  \tab", "\tab", "    ab", " ab", "ab", "", "\t\t") for n in (0, 2, 4, 6)], "x string, n int")
    from foliant.functions.markdown import _cut

    assert all(r.got == _cut(r.x, r.n) for r in rows.select("x", "n", cut_columns(F.col("x"), F.col("n")).alias("got")).collect())
