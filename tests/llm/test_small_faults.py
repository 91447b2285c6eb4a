"""Settings with units, members of compressed bodies, charsets that pages name themselves, hashes without warnings."""

import gzip
import warnings
import zlib

import numpy as np
import pytest

from foliant.llm import common, warc

HEAD = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")]


def text_of(entity: bytes, *fields: bytes) -> str:
    block = b"\r\n".join([b"HTTP/1.1 200 OK", *fields]) + b"\r\n\r\n" + entity
    return warc.derive(HEAD, block)[1][1].decode()


def test_members_of_a_body(monkeypatch):
    assert text_of(gzip.compress(b"<p>one") + gzip.compress(b" two"), b"Content-Encoding: gzip") == "one two"
    assert text_of(gzip.compress(b"<p>one") + b"\0\0junk", b"Content-Encoding: gzip") == "one"
    assert text_of(gzip.compress(b"<p>" + b"word " * 100)[:-4], b"Content-Encoding: gzip").startswith("word word")
    assert text_of(b"not gzip", b"Content-Encoding: gzip") == ""
    monkeypatch.setattr(warc, "MOST_BYTES", 1000)
    assert text_of(gzip.compress(b"x" * 1001), b"Content-Encoding: gzip") == ""
    assert text_of(gzip.compress(b"x" * 600) * 2, b"Content-Encoding: gzip") == ""
    assert text_of(gzip.compress(b"x" * 500) * 2, b"Content-Encoding: gzip") == "x" * 1000
    with pytest.raises(zlib.error):
        warc.inflated(b"junk", 47)


def test_charset_of_a_page():
    page = lambda c: f"<html><meta charset='{c}'><p>caf\u00e9".encode("latin-1")
    assert text_of(page("iso-8859-1")) == "caf\u00e9"
    assert text_of(page("iso-8859-1"), b"Content-Type: text/html; charset=windows-1252") == "caf\u00e9"
    assert text_of(page("no-such-set")) == text_of("<p>caf\u00e9".encode("latin-1")) == "caf\ufffd"


def test_settings_with_units(spark):
    assert [common.byte_size(x) for x in ("64m", "268435456b", "8388608", "1g", "2kb", "-1")] == [64 << 20, 1 << 28, 8 << 20, 1 << 30, 2048, -1]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("64m", common.ARROW_BYTES), ("1m", 1 << 20)):
            spark.conf.set(key, given)
            common.tune(spark)
            assert common.byte_size(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


def test_hashes_of_windows():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        r, data = common.Rolling(1), np.frombuffer(b"abcdefabcdef" * 40, np.uint8)
        p = r.prefix(data)
        every = r.every(p, 400)
        assert (every == r.of(p, np.arange(len(every)), np.arange(len(every)) + 400)).all() and every[0] == every[6]
