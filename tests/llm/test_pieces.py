"""Memory and work of record files and WARC derivatives."""

import base64
import hashlib
import io
import os
import tracemalloc

import numpy as np
import pyarrow as pa
from foliant.llm import tokens, warc
from foliant.llm.queries import tokenizer_path


def _file(sizes):
    ids = np.arange(sum(sizes)).astype(np.uint8)
    off = np.concatenate([[0], np.cumsum(sizes)])
    return tokens.frame(np.arange(len(sizes)), np.zeros(len(sizes), bool), ids, off, 2)[0]


def test_reading_holds_few_bytes_for_each_of_a_file():
    data = _file([2000] * 5000)
    tracemalloc.start()
    n = sum(1 for _ in tokens.records(io.BytesIO(data)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 5000 and peak < 60 << 20


def test_long_records_are_read_in_few_steps():
    reads = []

    class Stream(io.BytesIO):
        def read(self, n=-1):
            reads.append(n)
            return super().read(n)

    sizes = [2, 12 << 20, 4]
    found = list(tokens.records(Stream(_file(sizes))))
    assert [len(ids) * 2 for _, ids in found] == sizes and len(reads) <= 5


def test_encoding_holds_few_words_as_strings():
    """Pipeline, token output: workers' memory came near an executor's on check_h."""
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}xq" for k in range(200_000)]
    e, text = tokens.Encoder(tokenizer_path(), 1), pa.array([" ".join(words)])
    tracemalloc.start()
    (got,) = e.encode(text).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    assert peak < 10 << 20, peak
    assert np.frombuffer(got, e.kind).tolist() == [*e.t.encode(" ".join(words), add_special_tokens=False).ids, 1]


def test_digests():
    for data in (b"", b"a", bytes(range(256)) * 9):
        assert warc.digest(data) == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_text_needs_no_paths_of_elements(monkeypatch):
    from foliant.llm import htmlmain

    page = '<title>T</title><div class="nav"><p>a &amp; b<p>c <a href="/x">d</a></div><script>no</script>'
    want = ("T", "a & b\nc d", ["/x"])
    assert warc.plain(page) == want
    monkeypatch.setattr(htmlmain, "_element", None)
    assert warc.plain(page) == want
