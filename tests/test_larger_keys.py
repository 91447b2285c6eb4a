"""What the structural operators do on larger tables: few shuffles and passes, and the same answers by each of their ways."""

import random

from foliant.operators import layout, running, structure
from foliant.plans import structure as plans

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _counted(monkeypatch, *modules):
    """Calls of checkpoints and the like, by name."""
    calls = []
    for module in modules:
        for name in ("reached", "intervals", "nearest_before"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **k: (calls.append(n), f(*a, **k))[1])
    return calls


def _passes(monkeypatch, df_of):
    """How often keys are counted."""
    calls = []
    frame = type(df_of)
    head = frame.head
    monkeypatch.setattr(frame, "head", lambda self, *a: (a or calls.append(1), head(self, *a))[1])
    return calls


def test_cell_grid_shuffles_once(spark):
    found = plans.cell_grid(spark, SF)
    assert _plan(found).count("Exchange hash") <= 2  # lines of an order, rows of a table


def test_folded_fields_counts_once(spark, monkeypatch):
    calls = _passes(monkeypatch, spark.range(1))
    plans.field_folding(spark, SF)
    assert len(calls) == 1


def test_small_keys_are_folded(spark, monkeypatch):
    calls = _counted(monkeypatch, layout)
    rng = random.Random(5)
    rows = [(k if k else None, n, rng.choice([None, -1.0, 0.0, 0.125, 2.5, 7.25, 30.0]), f"x{n}") for k in range(12) for n in rng.sample(range(900), 40 + 7 * k)]
    df = spark.createDataFrame(rows, "doc int, ord int, height double, note string")
    folded = sorted(map(str, layout.page_numbers(df, ["doc"], "ord", 10.0).collect()))
    assert not calls
    mixed = sorted(map(str, layout.page_numbers(df, ["doc"], "ord", 10.0, 80).collect()))
    doubled = sorted(map(str, layout.page_numbers(df, ["doc"], "ord", 10.0, 1).collect()))
    assert calls and folded == mixed == doubled and len(folded) == len(rows)


def test_descendants_by_beginnings(spark, monkeypatch):
    calls = _counted(monkeypatch, structure)
    rng = random.Random(6)
    rows = {(rng.randrange(3), tuple(rng.randrange(3) for _ in range(rng.randrange(6)))) for _ in range(400)}
    rows = [(d, list(p), rng.choice(["table", "row", "cell"])) for d, p in sorted(rows)]
    df = spark.createDataFrame(rows + rows[:20], "doc_id int, path array<int>, type string")
    for kind in (None, "cell", "table"):
        want = sorted((d, tuple(o), tuple(p)) for d, o, t in rows if t == "table" for e, p, u in rows if e == d and len(p) > len(o) and p[: len(o)] == o and kind in (None, u))
        for depths, places in ((8, 1_000_000), (8, 0), (0, 0)):
            monkeypatch.setattr(structure, "DEPTHS", depths)
            monkeypatch.setattr(structure, "PLACES", places)
            calls.clear()
            found = structure.child_nodes(df, "table", kind, True).collect()
            assert sorted((x.doc_id, tuple(x.origin), tuple(x.path)) for x in found) == want
            assert bool(calls) == (depths == 0)


def test_gathered_leaves_large_keys(spark):
    df = spark.createDataFrame([(1, k) for k in range(9)] + [(2, 0)], "a int, b int")
    assert running.gathered(df, ["a"], 8)[1] == 8
    assert running.gathered(df, ["a"], 9)[1] == float("inf")
    assert running.gathered(df.where("false"), ["a"], 9)[0].count() == 0
