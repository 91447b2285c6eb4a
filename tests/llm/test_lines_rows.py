"""Line dedup against brute force where ids are shared, null or repeated; the lines are equal when normalised or quite different."""

import random
import re

from pyspark.sql import functions as F

from foliant.llm import lines


def test_line_dedup_by_row(spark, monkeypatch):
    monkeypatch.setattr(lines, "RUN", 2)
    r = random.Random(9)
    pool = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(r.randint(2, 12))) for _ in range(60)] + ["--", "", " * "]
    rows = [(r.choice([1, 2, 2, 3, None]), "\n".join(r.choice([x, x, x.upper() + "!"]) for x in r.choices(pool, k=r.randint(1, 6)))) for _ in range(60)]
    rows += [rows[0]] * 6 + [rows[5]] * 2 + [(None, None), (None, None), (4, ""), (4, ""), (None, "only here alpha beta gamma delta"), (2, "unrelated opening words of its own\nshared tail"), (2, "another opening that is not that\nshared tail")]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, line_no int, kept string").repartition(3)
    key = {(x.doc_id, x.text): x.k for x in df.select("doc_id", "text", lines._row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, key[x]))
    seen, want = set(), []
    for k, (doc_id, text) in enumerate(order):
        if text is None:
            want.append((doc_id, 0, 0, None))
            continue
        kept = []
        for line in text.split("\n"):
            norm = re.sub(r"[\W_]+", " ", line.lower()).strip()
            if not norm or norm not in seen:
                kept.append(line)
            if norm:
                seen.add(norm)
        n = len(text.split("\n"))
        want.append((doc_id, n, n - len(kept), "\n".join(kept)))
    found = [tuple(x) for x in lines.dedup_lines(df).select("doc_id", "n_lines", "n_removed", "kept").collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))
