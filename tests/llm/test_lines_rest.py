"""What line dedup tests after its first links, its SimHash by rows, and groups of links against brute force."""

import random

from pyspark.sql import functions as F

from foliant.llm import lines
from foliant.llm.ngramjoin import connect


def _roots(pairs):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(root)}


def test_only_lines_that_are_still_apart_are_tested_again(spark, monkeypatch):
    """op6_line_dedup: near copies in one run whose first is another line were all compared with each other."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(300)]
    texts = []
    for _ in range(3):
        base = [r.choice(words) for _ in range(60)]
        for _ in range(60):
            x = list(base)
            x[r.randrange(60)] = r.choice(words)
            texts.append(" ".join(x))
    asked, linked = [], lines._linked

    def spy(pairs, known):
        asked.append([tuple(p) for p in pairs.select("a", "b").collect()])
        found = linked(pairs, known)
        asked.append([tuple(p) for p in found.select("a", "b").collect()])
        return found

    monkeypatch.setattr(lines, "_linked", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in lines.line_groups(df).where("keep").collect()}
    known = df.select("doc_id", F.xxhash64("text").alias("id"), lines.simhash(F.col("text")).alias("sim"), "text").collect()
    pairs = []
    for i, x in enumerate(known):
        for y in known[:i]:
            if bin((x.sim ^ y.sim) & (1 << 64) - 1).count("1") <= lines.DISTANCE and x.text != y.text:
                pairs.append((x.text, y.text, x.doc_id, y.doc_id))
    near = spark.createDataFrame(pairs, "x string, y string, a long, b long").where(F.levenshtein("x", "y") <= F.greatest(F.length("x"), F.length("y")) / 5).select("a", "b").collect()
    first = {t: k for k, t in reversed(list(enumerate(texts)))}
    roots = _roots([(first[texts[p.a]], first[texts[p.b]]) for p in near])
    assert kept == {k for t, k in first.items() if roots.get(k, k) == k}
    assert 0 < len(kept) < 150
    before = _roots(asked[1])
    assert not [p for p in asked[2] if before.get(p[0], p[0]) == before.get(p[1], p[1])]


def test_simhash_by_rows(spark):
    r = random.Random(2)
    sizes = [1, 2, 5, 126, 127, 128, 254, 255, 1000, lines.PIECE**2, lines.PIECE**2 + 1]
    texts = [" ".join(str(r.randrange(50 if k % 2 else 10**6)) for _ in range(n)) for k, n in enumerate(sizes)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[1])] * 400
    df = spark.createDataFrame(rows, "k int, norm string").repartition(3)
    want = sorted((x.k, x.s) for x in df.select("k", lines.simhash(F.col("norm")).alias("s")).collect())
    assert sorted((x.k, x.sim) for x in lines.with_simhash(df).collect()) == want


def test_links_of_all_shapes(spark):
    r = random.Random(4)
    name = list(range(-500, 500))
    r.shuffle(name)
    edges = [(name[k], name[k + 1]) for k in range(150)] + [(k, k + 1) for k in range(10_000, 10_100)]
    edges += [(name[200], name[k]) for k in range(201, 260)] + [(5000 + k, 6000) for k in range(40)]
    edges += [(name[r.randrange(300, 900)], name[r.randrange(300, 900)]) for _ in range(400)] + [(7, 7)] + edges[:20]
    found = [(x.node, x.root) for x in connect(spark.createDataFrame(edges, "a long, b long")).collect()]
    want = _roots([e for e in edges if e[0] != e[1]])
    assert len(found) == len(want) and dict(found) == want
