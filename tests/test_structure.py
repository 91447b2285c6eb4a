"""Structural operators against walks, stacks and counters over small constructed documents, plain and with every key split."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions.text import letters, roman_numeral
from foliant.operators import cascading, running, structure

#: Rows of a key that one window may sort: all, or hardly any.
SIZES = (running.HOT_ROWS, 3)


@pytest.mark.parametrize("hot", SIZES)
def test_running(spark, hot):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), k, r.choice([None, 1, -2, 3])) for k in range(60)]
    df = spark.createDataFrame([(*x, "kept") for x in rows], "k string, o int, v int, other string").repartition(3)
    scans = {"s": running.Scan("sum", F.col("v")), "sb": running.Scan("sum", F.col("v"), True), "m": running.Scan("min", F.col("v")), "l": running.Scan("last", F.col("v")), "lb": running.Scan("last", F.col("v"), True)}
    found = {x.o: x for x in running.running(df, ["k"], ["o"], scans, hot).collect()}
    assert len(found) == len(rows)
    for k, o, v in rows:
        upto = [x[2] for x in rows if x[0] == k and x[1] <= o and x[2] is not None]
        before = [x[2] for x in rows if x[0] == k and x[1] < o and x[2] is not None]
        x = found[o]
        assert (x.k, x.v, x.other, x.s, x.sb, x.m, x.l, x.lb) == (k, v, "kept", sum(upto), sum(before), min(upto, default=None), upto[-1] if upto else None, before[-1] if before else None)
    assert running.running(df.where("false"), ["k"], ["o"], scans, hot).count() == 0


@pytest.mark.parametrize("hot", SIZES)
def test_nearest_before(spark, hot):
    r = random.Random(2)
    marks = [(r.choice([1, 1, 2, None]), r.choice([None, *range(0, 50, 3)]), f"m{k}", k) for k in range(30)]
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(50)]), k) for k in range(80)]
    left = spark.createDataFrame([(*x, "old") for x in rows + rows[:3]], "d int, at int, n int, name string")
    right = spark.createDataFrame(marks, "d int, at int, name string, v int")
    found = running.nearest_before(left, right, ["d"], "at", ["name", "v"], hot).collect()
    assert len(found) == len(rows) + 3
    for x in found:
        before = [(m[1], m[2], m[3]) for m in marks if m[0] == x.d and m[1] is not None and x["at"] is not None and m[1] <= x["at"]]
        assert (x.name, x.v) == (max(before)[1:] if before else (None, None))
    assert running.nearest_before(left, right.where("false"), ["d"], "at", ["name", "v"], hot).where("name is not null").count() == 0


def tree():
    r = random.Random(3)
    nodes = {(1, ()): "document", (2, ()): "table", (3, (5,)): "run"}  # the last has no parent
    for k in range(150):
        doc, path = r.choice([n for n in nodes if n[0] < 3])
        nodes[doc, (*path, k)] = r.choice(["table", "row", "run"])
    deep = ()
    for k in range(120):  # a chain, nested tables
        deep = (*deep, 7)
        nodes[4, deep] = "table" if k % 2 else "row"
    return nodes


@pytest.mark.parametrize("hot", SIZES)
def test_child_nodes(spark, hot):
    nodes = tree()
    rows = [(d, list(p), t) for (d, p), t in nodes.items()]
    df = spark.createDataFrame([(*x, "x") for x in rows + rows[:5]], "doc_id int, path array<int>, type string, pre string")
    for deep in (False, True):
        for kind in ("run", "table", None):
            want = {(d, p, q, u) for (d, p), t in nodes.items() if t == "table" for (e, q), u in nodes.items() if d == e and q[: len(p)] == p and len(q) > len(p) and (deep or len(q) == len(p) + 1) and kind in (None, u)}
            found = structure.child_nodes(df, "table", kind, deep, hot_rows=hot).collect()
            assert len(found) == len(want)
            assert {(x.doc_id, tuple(x.origin), tuple(x.path), x.type) for x in found} == want


# --- fields


def folded(children):
    """A paragraph's text with a stack, as a reader of the rules would write it."""
    out, stack = [], []
    for kind, text in children:
        if kind == "field_start":
            stack.append(["", [], False])
        elif kind == "field_separator" and stack:
            stack[-1][2] = True
        elif kind == "field_end" and stack:
            code, result, _ = stack.pop()
            (stack[-1][1] if stack else out).append(link(code.strip(), "".join(result)))
        elif kind == "run":
            if not stack:
                out.append(text)
            elif stack[-1][2]:
                stack[-1][1].append(text)
            else:
                stack[-1][0] += text
    return "".join(out)


def link(code, label):
    if not code.upper().startswith("HYPERLINK"):
        return label
    got, pending = {"": "", "l": "", "o": ""}, ""
    for token in re.findall(r'\\+[a-zA-Z]|"[^"]*"|\S+', code[9:]):
        if re.fullmatch(r"\\+[a-zA-Z]", token):
            pending = token[-1]
            continue
        value = (token[1:-1] if len(token) > 1 and token[0] == token[-1] == '"' else token).replace("\\\\", "\\")
        if pending in ("l", "o"):
            got[pending] = value
        elif not got[""]:
            got[""] = value
        pending = ""
    address = got[""] + ("#" + got["l"] if got["l"] else "")
    if not address or not label:
        return label
    where = "<" + address.replace("<", "\\<").replace(">", "\\>") + ">" if re.search(r"\s", address) else re.sub(r"([()<>])", r"\\\1", address)
    title = ' "' + got["o"].replace('\\"', '"').replace('"', '\\"') + '"' if got["o"] else ""
    return f"[{label}]({where}{title})"


CODES = ['HYPERLINK "http://a/(b)"', ' hyperlink http://x "second" ', 'HYPERLINK "with space" \\o "a tip"', 'HYPERLINK \\l "place"', 'HYPERLINK "u" \\l "p" \\o "q" \\t "frame"', 'HYPERLINK "c:\\\\dir\\\\f"', "HYPERLINK", "PAGE", 'HYPERLINK "', 'HYPERLINK ""', 'HYPERLINK "a<b> c"']


@pytest.mark.parametrize("hot", SIZES)
def test_folded_fields(spark, hot):
    r = random.Random(4)
    whole = lambda code, *inner: [("field_start", None), ("run", code), ("field_separator", "x"), *inner, ("field_end", None)]
    paragraphs = [whole(c, ("run", "label"), ("run", "!")) for c in CODES]
    paragraphs += [whole(CODES[0]), whole(CODES[0], ("run", None)), whole(CODES[0], *whole(CODES[1], ("run", "in"))), whole(CODES[0], *whole("PAGE", ("run", "7")), ("run", "after"))]
    paragraphs += [[("field_start", None), *whole(CODES[1], ("run", "in code")), ("run", CODES[0]), ("field_separator", None), ("run", "out"), ("field_end", None)]]
    paragraphs += [[("field_end", None), ("run", "a"), ("field_separator", None), ("run", "b"), ("field_start", None), ("run", "lost"), *whole(CODES[0], ("run", "lost too"))], [("shape", "no run")], []]
    for _ in range(120):
        paragraphs.append([(k := r.choice(["field_start", "field_separator", "field_end", "field_end", "run", "run", "run"]), r.choice([*CODES, "a", "b ", "", None]) if k == "run" else None) for _ in range(r.randint(1, 14))])
    rows = [(k // 7 if k % 5 else None, k, o, kind, text) for k, p in enumerate(paragraphs) for o, (kind, text) in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id int, para int, ord int, kind string, text string").repartition(3)
    found = {(x.doc_id, x.para): x.text for x in structure.folded_fields(df, ["doc_id", "para"], hot_rows=hot).collect()}
    assert found == {(k // 7 if k % 5 else None, k): folded([(a, b or "") for a, b in p]) for k, p in enumerate(paragraphs) if p}


# --- styles


def test_style_chains(spark):
    deep = [(1, k, f"S{k}", f"S{k - 1}" if k else None, None) for k in range(300)]
    odd = [(2, 0, "a", "b", 1), (2, 1, "b", "c", None), (2, 2, "c", "b", 3), (2, 3, "own", "own", None), (2, 4, "lost", "nowhere", None), (2, 5, "none", "", 5), (2, 6, "a", "none", 9), (None, 0, "a", "b", 1), (2, 7, None, "a", 1)]
    df = spark.createDataFrame([(*x, "x") for x in deep + odd], "doc_id int, ord int, name string, base_style_name string, size int, ancestor string")
    found = {}
    chains = cascading.style_chains(df)
    for x in sorted(chains.collect(), key=lambda x: x.depth):
        found.setdefault((x.doc_id, x.name), []).append(x.ancestor)
    assert len(found) == 306 and all(found[1, f"S{k}"] == [f"S{j}" for j in range(k, -1, -1)] for k in range(300))
    assert {n: c for (d, n), c in found.items() if d == 2} == {"a": ["a", "b", "c"], "b": ["b", "c"], "c": ["c", "b"], "own": ["own"], "lost": ["lost", "nowhere"], "none": ["none"]}
    sizes = {(x.doc_id, x.name): x["size"] for x in cascading.cascade(df, chains, ["size"]).collect()}
    assert (sizes[2, "a"], sizes[2, "b"], sizes[2, "lost"], sizes[1, "S299"]) == (1, 3, None, None)


def test_resolved_runs(spark):
    styles = spark.createDataFrame([(1, 0, "Table", None, 1, "t", True), (1, 1, "Base", None, 2, "b", None), (1, 2, "Para", "Base", None, "", None), (1, 3, "Char", None, None, None, False), (1, 4, "Char", None, 99, "late", True)], "doc_id int, ord int, name string, base_style_name string, size int, color string, bold boolean")
    runs = [(1, 1, None, None, None, None, None, None), (1, 2, "Table", None, None, None, None, None), (1, 3, "Table", "Para", None, None, "", None), (1, 4, "Table", "Para", "Char", None, None, None), (1, 5, "Table", "Para", "Char", 7, "own", True), (1, 6, "Gone", "gone", None, None, None, None), (2, 7, "Table", "Para", "Char", None, None, None)]
    df = spark.createDataFrame(runs, "doc_id int, run_id int, table_style string, para_style string, run_style string, size int, color string, bold boolean")
    found = cascading.resolved_runs(df, styles, ["size", "color", "bold"], {"size": F.lit(22), "color": F.lit("auto"), "bold": F.lit(False)}, empty={"color": ""})
    assert found.columns == df.columns
    assert {x.run_id: (x["size"], x.color, x.bold) for x in found.collect()} == {1: (22, "auto", False), 2: (1, "t", True), 3: (2, "b", True), 4: (2, "b", False), 5: (7, "own", True), 6: (22, "auto", False), 7: (22, "auto", False)}


def test_used_styles(spark):
    styles = spark.createDataFrame([(1, "a", "b", None), (1, "b", "a", "c"), (1, "c", "gone", None), (1, "d", "a", None), (2, "a", None, None), (2, "b", None, "a")], "doc_id int, name string, base string, next string")
    used = spark.createDataFrame([(1, "a"), (1, "a"), (1, "unknown"), (2, "b"), (2, None)], "doc_id int, name string")
    found = cascading.used_styles(used, styles, ["base", "next"]).collect()
    assert sorted((x.doc_id, x.name) for x in found) == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")]
    assert cascading.used_styles(used.where("false"), styles, ["base"]).count() == 0


def test_used_styles_of_long_chains(spark, monkeypatch):
    """A chain of 120 styles, and one whose end is a cycle, cost a few dozen rounds at most, not one for each style."""
    rounds = []
    monkeypatch.setattr(cascading, "cut", lambda df: rounds.append(1) or running.cut(df))
    rows = [(1, f"s{n}", f"s{n + 1}" if n < 119 else None, None) for n in range(120)] + [(2, f"s{n}", f"s{(n + 1) % 60}", f"s{n // 2}") for n in range(60)] + [(2, "apart", "s0", "apart")]
    used = spark.createDataFrame([(1, "s7"), (2, "s3")], "doc_id int, name string")
    found = cascading.used_styles(used, spark.createDataFrame(rows, "doc_id int, name string, base string, next string"), ["base", "next"]).collect()
    assert sorted((x.doc_id, x.name) for x in found) == sorted([(1, f"s{n}") for n in range(7, 120)] + [(2, f"s{n}") for n in range(60)])
    assert len(rounds) < 40


def test_rows_of_a_task_stay_bounded(spark, monkeypatch):
    """Many rows are dealt to more tasks than the session's shuffles have; few are left as they are."""
    monkeypatch.setattr(running, "TASK_ROWS", 100)
    items = spark.range(3000).selectExpr("id % 500 AS doc_id", "1 AS list_id", "id AS ord", "CAST(id % 2 AS INT) AS level")
    levels = spark.range(500).selectExpr("id AS doc_id", "1 AS list_id", "array(named_struct('number_style', 0, 'number_format', '%1.', 'start_at', 1)) AS levels")
    found = structure.level_labels(items, levels).withColumn("task", F.spark_partition_id()).collect()
    assert {(x.doc_id, x.ord, x.label) for x in found} == {(k % 500, k, f"{k // 500 + 1}.") for k in range(3000)}
    assert max(sum(x.task == t for x in found) for t in {x.task for x in found}) < 300
    few = items.limit(50)
    assert running.dealt(few, ["doc_id"]) is few


# --- tables


@pytest.mark.parametrize("hot", SIZES)
def test_cell_grid(spark, hot):
    r = random.Random(5)
    tables = {t: [[(r.choice([None, 0, 1, 1, 2, 3]), r.choice([None, "restart", "continue", "continue"])) for _ in range(r.randint(1, 5))] if r.random() < 0.9 else [] for _ in range(r.randint(1, 7))] for t in [*range(25), None]}
    rows = [(t, a, 2 * b, *cell) for t, rs in tables.items() for a, cells in enumerate(rs) for b, cell in enumerate(cells)]
    found = structure.cell_grid(spark.createDataFrame([(*x, "x") for x in rows + rows[:4]], "t int, row_idx int, col_idx int, grid_span int, v_merge string, anchor string"), ["t"], hot)
    want = set()
    for t, rs in tables.items():
        above = {}
        shown = {}
        for a, cells in enumerate(rs):
            at, now = 0, {}
            for b, (span, merge) in enumerate(cells):
                span = max(span or 1, 1)
                top = above.get(at) if merge == "continue" else None
                key = top or (a, 2 * b, at, span)
                shown[key] = shown.get(key, 0) + 1
                if merge:
                    now[at] = key
                at += span
            above = now
        want |= {(t, a, b, g, n, span) for (a, b, g, span), n in shown.items()}
    got = [(x.t, x.row_idx, x.col_idx, x.grid_col, x.row_span, x.col_span) for x in found.collect()]
    assert len(got) == len(want) and set(got) == want


# --- lists


@pytest.mark.parametrize("hot", SIZES)
def test_level_labels(spark, hot):
    r = random.Random(6)
    formats = ["%1.", "%1.%2.", "%3)", "%9-%0", "", None, "(%2%%1)", "*"]
    lists = {n: [(r.choice([0, 1, 2, 3, 4, 23, 255, 5, None]), r.choice(formats), r.choice([None, 0, 1, 1, 4])) for _ in range(r.choice([0, 1, 3, 9]))] for n in range(12)}
    items = [(1, r.choice([*lists, 99]), o, r.randint(0, 8)) for o in range(400)]
    df = spark.createDataFrame([(*x, "x") for x in items], "doc_id int, list_id int, ord int, level int, s string")
    defined = spark.createDataFrame([(1, n, ls) for n, ls in lists.items()], "doc_id int, list_id int, levels array<struct<number_style int, number_format string, start_at int>>")
    show = {0: str, 1: roman_numeral, 2: lambda n: roman_numeral(n).lower(), 3: letters, 4: lambda n: letters(n).lower()}
    counters, want = {}, {}
    for _, n, o, level in items:
        levels = lists.get(n)
        if not levels:
            want[o] = None
            continue
        level = min(level, len(levels) - 1)
        style, form, start = levels[level]
        if style in (23, 255):
            want[o] = form
            continue
        counters[n, level] = counters[n, level] + 1 if (n, level) in counters else max(start or 0, 1)
        counters = {k: v for k, v in counters.items() if k[0] != n or k[1] <= level}

        def one(m, n=n, levels=levels, style=style):
            k = int(m[1]) - 1
            own = (levels[k][0] or 0) if 0 <= k < len(levels) else (style or 0)
            return show.get(own, str)(counters.get((n, k), 0))

        want[o] = re.sub(r"%(\d)", one, form or "%1.")
    assert {x.ord: x.label for x in structure.level_labels(df, defined, hot_rows=hot).collect()} == want


@pytest.mark.parametrize("hot", SIZES)
def test_list_groups(spark, hot):
    r = random.Random(7)
    rows = [(r.choice([1, 1, 2, None]), o, r.choice([0, 1, 2, 2, None]), r.choice([True, False, None]), r.choice(["x", "y", " ", None]), r.choice([None, False, False, True])) for o in range(150)]
    found = structure.list_groups(spark.createDataFrame(rows, "doc_id int, ord int, list_ref int, is_bullet boolean, text string, in_table boolean"), hot_rows=hot)
    want, state = {}, {}
    for doc, o, ref, bullet, text, table in rows:
        group, before, kind = state.get(doc, (1000, False, None))
        item = bool(ref) and not table and bool(text and text.strip())
        if item and (not before or bool(bullet) != kind):
            group, kind = group + 1, bool(bullet)
        want[o] = group if item else None
        state[doc] = (group, item, kind)
    assert {x.ord: x.group_id for x in found.collect()} == want


# --- shapes


def test_group_boxes(spark):
    r = random.Random(8)
    num = lambda: r.choice([None, 0, 8, 16, -24])
    groups = {n: (r.choice([None, 99, *range(n)]) if n else None, num(), num(), num(), num(), r.choice([None, 0.5, 2.0, 0.0]), r.choice([None, 1.0, 4.0])) for n in range(40)}
    for k in range(40, 90):  # a deep chain
        groups[k] = (k - 1, 8, 8, 0, 0, 1.0, 1.0)
    groups |= {200: (201, 1, 1, 0, 0, 1.0, 1.0), 201: (200, 1, 1, 0, 0, 1.0, 1.0), 202: (201, 1, 1, 0, 0, 1.0, 1.0)}
    shapes = [(k, r.choice([*range(90), None, 500, 202]), num(), num(), num(), num()) for k in range(150)]
    df = spark.createDataFrame([(1, k, *v) for k, v in groups.items()], "doc_id int, group_id int, parent_id int, x int, y int, ch_x int, ch_y int, sx double, sy double")
    found = structure.group_boxes(df, spark.createDataFrame([(1, *s) for s in shapes], "doc_id int, shape_id int, group_id int, x int, y int, cx int, cy int"), unit=8.0)

    def walk(n):
        """(offset, scale that the group was given, its own scale) on both axes."""
        parent, x, y, _, _, sx, sy = groups[n]
        place, own = (x or 0, y or 0), (1.0 if sx is None else sx, 1.0 if sy is None else sy)
        if parent not in groups:
            return tuple(p / 8 for p in place), (1.0, 1.0), own
        off, given, scale = walk(parent)
        return tuple(o + p * g / 8 for o, p, g in zip(off, place, given)), scale, tuple(a * b for a, b in zip(scale, own))

    for x in found.collect():
        n, at, ext = x.group_id, (x.x or 0, x.y or 0), (x.cx or 0, x.cy or 0)
        if n == 202:
            assert x.left is None and x.width is None
            continue
        off, scale, ch = ((0, 0), (1, 1), (0, 0))
        if n in groups:
            off, _, scale = walk(n)
            ch = (groups[n][3] or 0, groups[n][4] or 0)
        want = [*(o + (a - c) * s / 8 for o, a, c, s in zip(off, at, ch, scale)), *(e * s / 8 for e, s in zip(ext, scale))]
        assert [x.left, x.top, x.width, x.height] == pytest.approx(want)


# --- images


@pytest.mark.parametrize("hot", SIZES)
def test_image_links(spark, hot):
    data = bytes(range(100))
    rows = [(1, 0, None, "http://x/a (b)", "A", None), (1, 1, b"", None, None, "image/png"), (1, 2, data, None, None, "image/png"), (1, 3, data, "dir/p.x", "", "image/gif"), (1, 4, data, "dir/..", "up", None), (None, 0, data, "./", "", "image/tiff"), (1, 5, data, "", "n", "image/webp")]
    df = spark.createDataFrame([(*x, "x") for x in rows], "doc int, ord int, content binary, source string, alt string, content_type string, file string").drop("file")
    got = lambda **how: {(x.doc, x.ord): (x.markdown, x.file) for x in structure.image_links(df, ["doc"], hot_rows=hot, **how).collect()}
    inline = got()
    assert inline[1, 0] == ("![A](<http://x/a (b)>)", None) and inline[1, 1] == ("![]()", None)
    import base64

    assert inline[1, 2] == (f"![](data:image/png;base64,{base64.b64encode(data).decode()})", None) and inline == got(folder="f", as_base64=True)
    files = got(folder="out/img", output_dir="out")
    assert {k: v for k, v in files.items() if v[1]} == {(1, 2): ("![](img/image1.png)", "out/img/image1.png"), (1, 3): ("![dir/p.x](img/p.x)", "out/img/p.x"), (1, 4): ("![up](img/..)", "out/img/.."), (None, 0): ("![./](img/image1.tiff)", "out/img/image1.tiff"), (1, 5): ("![n](img/image4.png)", "out/img/image4.png")}
    assert got(folder="out", output_dir="out")[1, 3][0] == "![dir/p.x](p.x)" and got(folder="out/img")[1, 3][0] == "![dir/p.x](out/img/p.x)" and got(folder="out", alias="cdn/")[1, 3] == ("![dir/p.x](cdn/p.x)", "out/p.x")
