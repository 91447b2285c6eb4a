"""Record files where one id, or null, has most rows: several files share it, and the order holds from file to file."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from foliant.llm import tokens
from foliant.llm.common import work_dir
from foliant.llm.queries import tokenizer_path


def test_hot_ids(spark):
    r = random.Random(1)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "é"]) + str(r.randint(0, 99)) for _ in range(r.randint(0, 6)))
    rows = [(None, text()) for _ in range(400)] + [(7, text()) for _ in range(300)] + [(k, text()) for k in range(-50, 150, 2)] + [(-(1 << 63), "least"), ((1 << 63) - 1, None)]
    df = spark.createDataFrame([(*x, "clash", 0) for x in rows], "doc_id long, text string, ids string, part int").repartition(3)
    layout = tokens.layout_of(df, 8)
    assert layout.shares.sum() < 24 and sorted(layout.shares)[-2:] == [3, 4]
    path, files = tokens.write_records(df, tokenizer_path(), work_dir(spark, "t"), partitions=8)
    found = sorted(tokens.read_records(spark, path, files).collect(), key=lambda x: x.start)
    assert len(found) == len(rows) and sum(f.records for f in files) == len(rows)
    ids = [x.doc_id for x in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for hot in (None, 7):
        assert len({x.part for x in found if x.doc_id == hot}) > 1
    encode = Tokenizer.from_file(tokenizer_path())
    want = sorted((i is not None, i or 0, zlib.crc32(np.array([*encode.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in rows)
    assert sorted((x.doc_id is not None, x.doc_id or 0, x.ids_crc32) for x in found) == want
    start = 0
    for x in found:
        assert x.start == start
        start += x.n_tokens
