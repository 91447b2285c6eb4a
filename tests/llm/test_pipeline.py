"""The pipeline on small tables, each stage against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from foliant.llm import mixing, ngramjoin
from foliant.llm.queries import tokenizer_path


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(11)
    vocabulary = {"en": ["the", "and", "thing", "with", "other", "house", "river"], "de": ["und", "der", "schön", "für", "haus", "fluss", "nicht"]}
    item = " ".join(r.choice(vocabulary["en"]) + str(k) for k in range(30))
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(r.choice(vocabulary[lang]) + r.choice(["", "er", "en", "ly"]) + str(r.randrange(9)) for _ in range(60)), lang, f"s{i % 4}", 0))
    rows += [(100, rows[5][1], "en", "s0", 0), (101, rows[7][1] + " more", "en", None, 0), (102, None, "en", "s1", 0), (103, "12 34 --", None, "s1", 0), (104, "", "de", "s1", 0), (105, item + " and the end", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / f"out{len(kept)}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(Counter(x.doc_id for x in docs.collect()))
    text = {x[0]: x[1] for x in rows}
    assert set(kept[0]) == {i for i, t in text.items() if t and re.search("[a-z]", t)}
    assert set(kept[1]) == set(kept[0]) - {100, 101}
    assert set(kept[2]) == set(kept[1]) - {105}
    before = spark.read.parquet(str(tmp_path / "out2"))
    want = {x.doc_id: x.copies for x in mixing.mix_sources(before).collect() if x.copies}
    assert kept[3] == want and sum(want.values()) > len(kept[2])

    t = Tokenizer.from_file(tokenizer_path())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in got) == kept[3]
    for x in got:
        ids = np.array([*t.encode(text[x.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (x.n_tokens, x.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    starts = sorted((x.start, x.n_tokens) for x in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_at_five_words(spark):
    """Pairs whose 5-word similarity reaches 0.8 go though their 3-word similarity is below 0.9; less similar ones stay."""
    words = [f"w{k}" for k in range(55)]
    near, far = list(words), [w + "x" for w in words]
    near[25] = "zz"
    apart = list(far)
    apart[10] = apart[40] = "zz"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(apart))]

    def jaccard(a, b, n):
        x, y = ({tuple(t[k : k + n]) for k in range(len(t) - n + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    assert jaccard(words, near, 5) >= 0.8 and jaccard(words, near, 3) < 0.9 and jaccard(far, apart, 5) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3, 4}


def test_rows_without_ids_and_repeated_rows(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a, "s"), (None, a + " more", "s"), (2, b, "t"), (2, b, "s"), (None, c, "t"), (None, c, "t"), (None, c + " more", "s"), (3, d + " end", "s"), (4, "", "s"), (None, None, "s"), (None, "other", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    of_c = [r for r in kept if r[1] and r[1].startswith("c0 ")]
    assert len(of_c) == 1 and of_c[0] in rows
    assert Counter(r for r in kept if r not in of_c) == Counter([rows[0], (2, b, "s"), *rows[7:]])

    spark.createDataFrame([(1, c), (2, d)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in clean) == Counter(r for r in rows if not (r[1] or "").startswith(("c0 ", "d0 ")))


def test_components_of_rows_without_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(5, a), (None, a + " more"), (None, a), (7, a + " most"), (None, b), (None, b + " more"), (None, None), (9, None)]
    got = ngramjoin.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(5, 58, 5), (None, 59, 5), (None, 58, 5), (7, 59, 5), (None, 58, None), (None, 59, None), (None, 0, None), (9, 0, 9)]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
