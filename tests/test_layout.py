"""Layout against loops over small constructed documents, plain and with every key split."""

import math
import random

import pytest

from foliant.operators import layout, running

SIZES = (running.HOT_ROWS, 3)


@pytest.mark.parametrize("hot", SIZES)
def test_page_numbers(spark, hot):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 2, None]), o, r.choice([None, 0, 1, 3, 7, 10, 10, 25, -4])) for o in range(160)]
    rows += [(5, o, 10) for o in range(70)] + [(6, 0, None)]
    df = spark.createDataFrame([(*x, "x") for x in rows], "doc int, ord int, height int, page string").drop("page").repartition(3)
    state, want = {}, {}
    for doc, o, h in rows:
        h = max(h or 0, 0)
        page, y, n = state.get(doc, (1, 0, 0))
        if n and y + h > 10:
            page, y = page + 1, 0
        state[doc] = (page, y + h, 1)
        want[doc, o] = page
    found = layout.page_numbers(df, ["doc"], "ord", 10.0, hot)
    assert found.columns == ["doc", "ord", "height", "page"]
    assert {(x.doc, x.ord): x.page for x in found.collect()} == want
    assert layout.page_numbers(df.where("false"), ["doc"], "ord", 10.0, hot).count() == 0


@pytest.mark.parametrize("hot", SIZES)
def test_balanced_columns(spark, hot):
    r = random.Random(2)
    sections = {k: [r.choice([None, 0, 2, 4, 10, 100]) for _ in range(r.randint(1, 12))] for k in [*range(30), None]}
    columns = {k: r.choice([1, 2, 3, 5, 60]) for k in sections}
    sections[31], columns[31] = [None, 0], 3
    rows = [(k, o, h, columns[k]) for k, hs in sections.items() for o, h in enumerate(hs)]
    found = layout.balanced_columns(spark.createDataFrame(rows, "section int, ord int, height int, columns int"), ["section"], "ord", 30.0, 20.0, 90.0, hot)
    want = {}
    for k, hs in sections.items():
        n, total = min(columns[k], layout.MOST_COLUMNS), sum(h or 0 for h in hs)
        target, y, column = min(30 + total / n, 90), 30.0, 0
        for o, h in enumerate(hs):
            h = h or 0
            if total > 0 and column < n - 1 and y + h / 2 > target:
                column, y = column + 1, 20.0
            want[k, o] = column
            y += h
    assert {(x.section, x.ord): x.column_idx for x in found.collect()} == want


def test_table_sizes(spark):
    r = random.Random(3)
    tables = {t: [[r.choice([None, 0.0, 10.0, 30.0, -5.0]) for _ in range(r.randint(1, 4))] for _ in range(3)] for t in range(40)}
    tables[40] = [[None, None]]
    cells = [(t, a, b, w, r.choice([None, 0.0, 12.0, 99.0]), r.choice([None, 7.0]), r.choice([None, True, False]), r.choice([None, False, True])) for t, rs in tables.items() for a, row in enumerate(rs) for b, w in enumerate(row)]
    df = spark.createDataFrame(cells, "t int, row_idx int, col_idx int, width double, text_width double, row_height double, wrap boolean, vertical boolean")
    widths = layout.column_widths(df, ["t"], 60.0)
    got = {(x.t, x.col_idx): x.width for x in widths.collect()}
    want = {}
    for t, rs in tables.items():
        n = max(map(len, rs))
        w = [max([0.0, *(row[k] or 0.0 for row in rs if k < len(row))]) for k in range(n)]
        zero = w.count(0.0)
        if zero == n:
            w = [60.0 / n] * n
        elif zero and sum(w) < 60:
            w = [x or (60 - sum(w)) / zero for x in w]
        scale = min(1.0, 60 / sum(w))
        want |= {(t, k): x * scale for k, x in enumerate(w)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    heights = {(x.t, x.row_idx): x.height for x in layout.row_heights(df.drop("width"), widths, ["t"]).collect()}
    need = {}
    for t, a, b, _, text, row, wrap, vertical in cells:
        inner, text = want[t, b] - 2 * layout.PAD_LEFT, text or 0.0
        h = text + 2 * layout.PAD_TOP if vertical else layout.LINE + 2 * layout.PAD_TOP if wrap is False else max(1, math.ceil(text / inner - layout.SLACK)) * layout.LINE + 2 * layout.PAD_TOP if inner > 1 else 0
        need[t, a] = max(need.get((t, a), layout.LEAST_ROW), h, row or 0)
    assert set(heights) == set(need) and all(heights[k] == pytest.approx(need[k]) for k in need)


def test_edge_borders(spark):
    r = random.Random(4)
    border = lambda: r.choice([None, None, (0, 0.0), (1, 0.0), (None, 2.0), (2, 1.5), (None, None)])
    layer = lambda: r.choice([None, tuple(border() for _ in range(6))])
    cells = [(t, a, b, border(), border(), border(), border()) for t in range(30) for a in range(3) for b in range(r.randint(1, 3))]
    tables = {t: (layer(), layer()) for t in range(28)}  # two have no row
    kind = "struct<line_style int, line_width double>"
    layers = f"struct<{', '.join(f'{n}: {kind}' for n in ('top', 'bottom', 'left', 'right', 'inside_h', 'inside_v'))}>"
    df = spark.createDataFrame(cells, f"t int, row_idx int, col_idx int, top {kind}, bottom {kind}, left {kind}, right {kind}")
    found = layout.edge_borders(df, spark.createDataFrame([(t, *v) for t, v in tables.items()], f"t int, own {layers}, style {layers}"), ["t"])
    shown = lambda b: b is not None and ((b[0] or 0) != 0 or (b[1] or 0) > 0)
    want = {}
    for t, a, b, *own in sorted(cells, key=lambda c: c[:3]):
        rows, cols = max(c[1] for c in cells if c[0] == t), max(c[2] for c in cells if c[0] == t)
        for k, (side, outer, edge) in enumerate([(own[0], a == 0, ("h", a, b)), (own[1], a == rows, ("h", a + 1, b)), (own[2], b == 0, ("v", b, a)), (own[3], b == cols, ("v", b + 1, a))]):
            slot = k if outer else 4 + k // 2
            entries = [x[slot] for x in tables.get(t, ()) if x is not None and x[slot] is not None]
            use = side if shown(side) else entries[0] if entries and shown(entries[0]) else None
            if use is not None:
                want[t, *edge] = use
    assert {(x.t, x.edge, x.line, x.place): tuple(x.border) for x in found.collect()} == want
