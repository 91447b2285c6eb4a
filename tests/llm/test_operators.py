"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import gzip
import hashlib
import html as htmllib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import decontam, htmlmain, langid, lines, mixing, ngramjoin, suffix, tokens, topk, warc
from foliant.llm.common import work_dir
from foliant.llm.queries import tokenizer_path

rng = random.Random(5)
WORDS = [("".join(rng.choice("abcdeéßñ'") for _ in range(rng.randint(1, 9)))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", ",", "\n"]) for _ in range(n))


BASE = prose(300, 1)
TEXTS = [
    BASE,
    BASE,
    BASE.replace(BASE.split()[40], "other", 1),
    BASE[: len(BASE) // 2] + prose(20, 2),
    prose(150, 3),
    prose(5, 4) + BASE[100:900] + prose(9, 6),
    "aaaa" * 400,
    "aaaa" * 400 + "b",
    "",
    None,
    "one two",
    "One two",
    "  \n\t ",
    "1 2 3",
    prose(9000, 7),
    "<|endoftext|> It's A Test\x1cwith  odd　spaces é",
]
DOCS = [(i * 3, t, ["en", "fr", None][i % 3], [None, "a", "b", "a"][i % 4], "x") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    path, files = tokens.write_records(docs, tokenizer_path())
    got = tokens.read_records(spark, path, files).orderBy("doc_id").collect()
    start = 0
    for r, (doc, text, *_) in zip(got, DOCS, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    fs, base = tokens._open(path)
    part = files[0].part
    assert sorted(d for d, _ in tokens.shuffled(fs, base, part, 1)) == sorted(r.doc_id for r in got if r.part == part)
    assert [d for d, _ in tokens.shuffled(fs, base, part, 1)] == [d for d, _ in tokens.shuffled(fs, base, part, 1)]
    path, files = tokens.write_records(none, tokenizer_path())
    assert tokens.read_records(spark, path, files).count() == 0


ODD = ["a", "B", "é", "ß", "Σ", "ς", "\u0301", "\u0308", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\u3000", "'s", "'T", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "1", "23", "\x01", "\x00", "中", "İ", "!!", "of", "the"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_encode_as_whole_texts_do(name):
    """By words where the file proves that they encode alone, else whole: 4,000 odd strings, both ways."""
    e, r = tokens.Encoder(tokenizer_path(name), 1), random.Random(3)
    assert (e.between is not None) == (name == "word_bpe_49k.json") == tokens.words_alone(tokenizer_path(name))
    texts = [*TEXTS, *["".join(r.choices(ODD, k=r.randint(0, 14))) for _ in range(4000)], "\x01", "\x01 \x01 a\x01b"]
    want = [np.array([*x.ids, 1], e.kind).tobytes() for x in e.t.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert e.encode(pa.array(texts)).to_pylist() == want
    assert e.encode(pa.array([], pa.string())).to_pylist() == []


def test_token_records_of_null_and_shared_ids(spark):
    docs = spark.createDataFrame([(None, "b c"), (2, "one two"), (2, "a"), (None, None), (1, "x")], "doc_id long, text string")
    path, files = tokens.write_records(docs, tokenizer_path())
    got = sorted(tokens.read_records(spark, path, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 2]
    assert sorted(r.n_tokens for r in got[:2]) == [1, 3] and got[-1].start + got[-1].n_tokens == sum(f.ids for f in files)


def test_checksums_and_broken_files():
    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (tokens.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert slow(b"123456789") == 0xE3069283  # the check value of CRC-32C
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (4, 5, 255, 256, 257, 512, 1000, 3000)]
    off = np.cumsum([0, *map(len, parts)])
    assert list(tokens.crc32c(np.frombuffer(b"".join(parts), np.uint8), off)) == list(map(slow, parts))
    ids = np.array([5, 6, 7, 1], "<u2")
    data, _, _ = tokens.frame(np.array([3, 4]), np.array([False, True]), ids.view(np.uint8), np.array([0, 6, 8]), 2)
    assert [(d, list(x)) for d, x in tokens.records(tokens._Once(data))] == [(3, [5, 6, 7]), (None, [1])]
    for bad in (data[:-1], data[:30] + b"\xff" + data[31:]):
        with pytest.raises(tokens.BadRecord):
            list(tokens.records(tokens._Once(bad)))


def test_language(spark, docs, none):
    r = random.Random(2)
    word = {"aa": ["the", "and", "thing", "with"], "bb": ["und", "der", "schön", "für"]}
    rows = [(i, " ".join(r.choice(word[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    known = spark.createDataFrame([*rows, (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(known.where(~langid.held_out(F.col("doc_id"))))
    assert model.languages == ["aa", "bb"]
    held = langid.predict(known.where(langid.held_out(F.col("doc_id"))).where("lang is not null and text is not null"), model)
    assert held.where("lang_pred <> lang").count() == 0 and held.count() > 5
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for doc, text, *_ in DOCS:
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
        else:
            want = langid.scores(model, text)
            p = 1 / np.exp(want - want.max()).sum()
            assert got[doc].lang_pred == model.languages[int(want.argmax())] and got[doc].score == pytest.approx(p, rel=1e-5)
    assert got[0].ids == "x"
    own = Counter()
    for _, t, k in rows:  # counts by hand: every 1-, 2- and 3-gram of one language's texts
        if k == "aa" and zlib.crc32(str(_).encode()) % 4 != 2:
            own.update(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))
    total = sum(own.values())
    for g in ("t", "an", "the", "x"):
        place = next(iter(langid.grams(g))) if len(g) == 1 else [*langid.grams(g)][-1]
        assert model.log_prob[0, place[0]] == pytest.approx(np.log(own[g] + 0.5) - np.log(total + 0.5 * langid.BUCKETS), rel=1e-5)
    again = known.unionByName(known)  # repeated rows weigh twice and change no prediction
    assert [r.lang_pred for r in langid.predict(docs, langid.fit(again)).orderBy("doc_id").collect()] == [r.lang_pred for r in langid.predict(docs, langid.fit(known)).orderBy("doc_id").collect()]
    empty = langid.fit(none)
    assert empty.languages == [] and {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_repeated_bytes(docs, none):
    for length in (80, 400):
        texts = {d: (t or "").encode() for d, t, *_ in DOCS}
        count = Counter(t[k : k + length] for t in texts.values() for k in range(len(t) - length + 1))
        got = {r.doc_id: r for r in suffix.repeated(docs, length).collect()}
        assert len(got) == len(DOCS)
        for d, t in texts.items():
            gone = np.zeros(len(t), bool)
            for k in range(len(t) - length + 1):
                if count[t[k : k + length]] > 1:
                    gone[k : k + length] = True
            kept = bytes(np.frombuffer(t, np.uint8)[~gone])
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            assert (got[d].n_bytes, got[d].n_removed, len(got[d].spans), bytes(got[d].kept)) == (len(t), gone.sum(), spans, kept), d
    assert suffix.repeated(none).count() == 0


def low_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_contamination(spark, docs, none):
    items = [(1, " ".join(BASE.split()[20:60])), (10, "One two"), (2, " ".join(BASE.split()[50:63])), (3, None), (4, "..."), (5, "a"), (None, "two"), (2, " ".join(BASE.split()[50:63])), (7, prose(40, 3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = low_words(t)
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    for bound in (decontam.MOST_WINDOWS, 40):  # in one pass; in several, with items cut into parts
        decontam.MOST_WINDOWS, before = bound, decontam.MOST_WINDOWS
        try:
            got = {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}
        finally:
            decontam.MOST_WINDOWS = before
        for d, t, *_ in DOCS:
            w, hit, found = low_words(t), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit.update(range(k, k + n))
                        found |= windows[tuple(w[k : k + n])]
            assert (got[d].n_words, got[d].n_hit, got[d].items, got[d].contaminated) == (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)), d
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in decontam.contamination(twice, bench).collect()) == [(0, 0, 0), (0, 1, 1), (1, 2, 1), (1, 2, 1)]


def test_line_dedup(spark, none):
    long = " ".join(WORDS[:60])
    rows = [(1, f"{long}\nkeep me\n\n--"), (2, f"{long} extra\nKeep, me!\n--"), (3, None), (4, ""), (None, long), (5, "keep you all here now"), (6, long.replace(WORDS[7], "zz", 1)), (7, " ".join(WORDS * 2)), (8, " ".join(WORDS * 2) + " tail")]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[1].kept == rows[0][1] and got[1].n_removed == 0
    assert got[2].kept == "--" and got[2].n_lines == 3
    assert got[3].kept is None and got[3].n_lines == 0
    assert got[4].kept == "" and got[5].kept == rows[5][1]
    assert got[6].n_removed == 1 and got[None].n_removed == 1 and got[7].n_removed == 0 and got[8].n_removed == 1
    assert lines.dedup_lines(none).count() == 0


def test_line_simhash(spark):
    texts = ["a", "a b", " ".join(WORDS[:127]), " ".join(WORDS[:129]), " ".join(w.strip("'") or "q" for w in WORDS)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines.simhash(F.col("t")).alias("s"), F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h")).collect()

    def majority(hashes):
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for r in rows:
        h = [x & (1 << 64) - 1 for x in r.h]
        want = majority(h) if len(h) <= lines.PIECE else majority([majority(h[k : k + lines.PIECE]) for k in range(0, len(h), lines.PIECE)])
        assert r.s & (1 << 64) - 1 == want


def test_line_distance(spark):
    rng = random.Random(3)
    rows = [("", "", 0), ("", "a", 0), ("same", "same", 0), ("abc" * 400, "abc" * 200 + "x" + "abc" * 200, 1)]
    for _ in range(400):
        x = "".join(rng.choice("abé 中") for _ in range(rng.randrange(60)))
        y = list(x)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randrange(3)] = rng.choice(["", "a", "bé"])
        rows.append((x, "".join(y), rng.randrange(10)))
    got = spark.createDataFrame(rows, "x string, y string, m int").select("x", "y", "m", lines._within(F.col("x"), F.col("y"), F.col("m")).alias("near")).collect()

    def distance(x, y):
        last = list(range(len(y) + 1))
        for i, a in enumerate(x):
            row = [i + 1]
            for j, b in enumerate(y):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (a != b)))
            last = row
        return last[-1]

    assert len({r.near for r in got}) == 2
    for r in got:
        assert r.near == (distance(r.x, r.y) <= r.m), r


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu {0}</a></li></ul></nav><!-- ad --><div class="ad">Buy {0}</div><article><h1>Head {0} &amp; all</h1><p><b>Bold{0}</b>ly &lt;b&gt;<br>next<p>More  text {0}</p><div class="comments">no</div><form><p>f</p></form></article><footer>&copy; x</footer></body></html>'


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(6)]
    rows += [(10, None, None), (11, "http://h.example/e", ""), (12, "nohost", "<p>Only <i>this</i></p><nav>menu</nav>"), (13, "http://z.example", "just text &amp; more"), (14, "http://z.example", "<div><aside>x</aside>"), (2, "http://h.example/2", PAGE.format(2))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, container string")
    got = sorted((r.page_id, r.text) for r in htmlmain.main_text(df).collect())
    want = sorted([(i, f"Head {i} & all Bold{i}ly <b> next More text {i}") for i in (0, 1, 2, 2, 3, 4, 5)] + [(10, ""), (11, ""), (12, "Only this"), (13, "just text & more"), (14, "")])
    assert got == want
    assert {r.container for r in htmlmain.containers(df.select(F.lit("h").alias("host"), F.col("page_id").alias("key"), "html").where("page_id < 6")).collect()} == {"html/body/article"}
    assert htmlmain.main_text(df.limit(0)).count() == 0


def test_main_text_of_sibling_divs(spark):
    """No article or main: headline, lead and body are slots of their own, one of them on few pages; none may go."""
    page = '<html><body><div class="menu">m</div><div class="content"><div class="lead"><h1>Head {0}</h1><p>' + "lead{0} " * 35 + '</p></div><div class="body"><p>' + "body{0} " * 65 + "</p></div>{1}</div><div class='footer'>f {0}</div></body></html>"
    want = {i: " ".join(f"Head {i} {f'lead{i} ' * 35}{f'body{i} ' * 65}{f'late {i}' if i == 4 else ''}".split()) for i in range(6)}
    rows = [(i, f"http://h.example/{i}", page.format(i, f'<div class="late">late {i}</div>' if i == 4 else "")) for i in range(6)]
    rows.append((9, "http://alone.example/", page.format(0, "")))  # too few pages for a template
    got = {r.page_id: r.text for r in htmlmain.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want | {9: want[0]}


def test_main_text_by_template_alone(spark):
    """No element or class name tells the menu, advert and footer, which vary from page to page: only the deduced slots do."""
    page = "<html><body><div class='q1'><a>go{0}</a> <a>up{0}</a></div><div class='q2'><div class='q3'>buy{0} now</div><div class='q4'><div class='q6'><h1>Head {0}</h1></div><div class='q7'><p>" + "word{0} " * 90 + "</p><p>more {0}</p></div></div></div><div class='q5'>seen {0} times</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(6)]
    df = spark.createDataFrame([*rows, (7, "http://few.example/", page.format(7))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmlmain.main_text(df).collect()}
    want = {i: " ".join(f"Head {i} {f'word{i} ' * 90} more {i}".split()) for i in range(6)}
    assert {i: got[i] for i in want} == want
    assert "buy7" in got[7] and htmlmain.extract(page.format(1)) != want[1]  # without a template nothing tells them
    none = spark.createDataFrame([(None, None, "<p>a</p>"), (None, None, "<p>a</p>"), (3, "u", "<p>" + "x " * 300_000)], "page_id long, url string, html string")
    assert sorted(len(r.text) for r in htmlmain.main_text(none).collect()) == [1, 1, 599_999]


def test_main_text_without_template_text(spark):
    """A paragraph that all pages of a host share goes; one that only copies of a page share stays, as do a host's equal pages."""
    page = "<html><body><article><h1>Head {0}</h1><p>Text {0} of it</p><p>Read also our <b>other</b> pages</p></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(min(i, 3))) for i in range(6)] + [(6, "http://h.example/6", "")]
    rows += [(10 + i, f"http://same.example/{i}", page.format(0)) for i in range(4)]
    got = {r.page_id: r.text for r in htmlmain.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Head {min(i, 3)} Text {min(i, 3)} of it" for i in range(6)} | {6: ""} | {10 + i: "Head 0 Text 0 of it Read also our other pages" for i in range(4)}


def test_warc(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(4)] + [(9, None, None)]
    path, files = warc.build(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)), work_dir(spark, "t"))
    got = {int(r.source): r for r in warc.read_pairs(spark, path, files).collect()}
    assert len(got) == 5 and sum(f.records for f in files) == 5
    for i, url, page in rows:
        r = got[i]
        assert r.url == url and r.payload_digest == warc.digest((page or "").encode()) and r.conversion_digest == warc.digest(r.text.encode())
        if page:
            want = [x for x in (" ".join(htmllib.unescape(re.sub("<[^>]*>", "", y)).split()) for y in re.split(r"<(?:/?(?:p|h1|br|div|li|ul|nav|article|form|footer|body|html|head)\b[^>]*|!--.*?--)>", re.sub(r"(?s)<(script|style|title).*?</\1>", "<p>", page))) if x]
            assert r.text.split("\n") == want and r.title == "T" and r.n_links == 1
        else:
            assert r.text == ""
    head, block = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], b"HTTP/1.1 200 OK\r\n\r\n<p>hi"
    (m, _), (c, text) = warc.derive(head, block)
    assert warc.value(m, "WARC-Refers-To") == warc.value(c, "warc-refers-to") == "<urn:uuid:1>" and text == b"hi"
    assert warc.derive([("WARC-Type", "request")], b"") == []
    head += [("WARC-Concurrent-To", "<urn:uuid:2>"), ("WARC-Concurrent-To", "<urn:uuid:3>")]
    page = gzip.compress(b"<p>hi")
    chunks = b"".join(b"%x;x=y\r\n%s\r\n" % (len(c), c) for c in (page[:9], page[9:])) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    (m, meta), (c, text) = warc.derive(head, block)
    e = json.loads(meta)["Envelope"]
    assert text == b"hi" and e["WARC-Header-Metadata"] == [list(x) for x in head] and e["Payload-Digest"] == warc.digest(chunks)
    assert e["HTTP-Response-Metadata"]["Headers"][:2] == [["Set-Cookie", "a"], ["Set-Cookie", "b"]]
    assert warc.derive(head, b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\nxx")[1][1] == b""
    empty = warc.responses(spark.createDataFrame([], "page_id long, url string, html string, headers string, block string"))
    path, files = warc.build(empty, work_dir(spark, "t"))
    assert files == [] and warc.read_pairs(spark, path, files).count() == 0
    longest = spark.createDataFrame([(1, "u", "<p>" + "word " * 400_000, "clash"), (1, "u", None, "clash")], "page_id long, url string, html string, headers string")
    path, files = warc.build(warc.responses(longest), work_dir(spark, "t"))
    assert sorted(len(r.text) for r in warc.read_pairs(spark, path, files).collect()) == [0, 400_000 * 5 - 1]
    assert all(f.name.startswith("part-") for f in files)
    assert warc.members(warc.record(c, text))[0][1] == b"hi"
    with pytest.raises(ValueError):
        warc.members(warc.record(c, text)[:-9])


def test_top_k(spark):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(300, 6)), 1)
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)] + [(400, [float(v) for v in x[0]]), (450, None), (500, [None] + [1.0] * 5), (550, [float("nan")] + [1.0] * 5), (None, [1.0] * 6), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (650, [])]
    df = spark.createDataFrame([(*y, 1) for y in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(z) for z in topk.top_k(df).collect())
    good = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and all(z is not None and np.isfinite(z) for z in v)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_mixing(spark, docs, none):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["a", "b", "c", "d", None, "e"] + ["a"] * 6)) for i in range(900)]
    df = spark.createDataFrame([*rows, (901, None, "c"), (5, rows[5][1], rows[5][2])], "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == 902 and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))
    size, taken, target = Counter(), Counter(), {}
    for x in got:
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.taken <= 2 * x.size
    names = [*sorted(s for s in size if s is not None), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, free, left = {}, list(names), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[z] for z in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * size[s]
            left -= want[s]
            free.remove(s)
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 60
    assert mixing.mix_sources(none).count() == 0
    copies = mixing.mixed_documents(docs, mixing.mix_sources(docs))
    assert copies.columns == docs.columns
    assert copies.groupBy("doc_id").count().where("count > 2").count() == 0


def test_components(docs, none):
    sets = {}
    for d, t, *_ in DOCS:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.components(docs).collect()}
    assert got == {d: (len(sets[d]), root[d]) for d in sets}
    assert len(set(root.values())) < len(root) and ngramjoin.components(none).count() == 0


def test_components_random(spark, monkeypatch):
    """Families around the threshold, in which the first member of a run is not near all others."""
    r = random.Random(8)
    rows = []
    for f in range(12):
        base = [r.choice("abcdefghijklmnop") + str(r.randrange(900)) for _ in range(r.choice([4, 9, 20, 60, 150]))]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = "x" + str(r.randrange(10**6))
            rows.append((len(rows), " ".join(w)))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(max(1, len(t.split()) - 2))} for _, t in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in ngramjoin.components(df).collect()}
    assert got == dict(enumerate(root))
    # the same where every signature counts as frequent and long runs are dealt out
    for name, value in (("SAMPLE", 1), ("LEAST_OFTEN", 2), ("RUN_SHARE", 3), ("RUN_BLOCK", 2), ("FIRST_RUNS", 1)):
        monkeypatch.setattr(ngramjoin, name, value)
    monkeypatch.setattr(ngramjoin, "parts", lambda spark, least=1: 1000)
    got = {x.doc_id: x.component_id for x in ngramjoin.components(df).collect()}
    assert got == dict(enumerate(root))


def test_segments_find_every_pair():
    """The signatures of any two sets within the threshold meet, whatever layout the costs choose."""
    r = np.random.default_rng(4)
    for counts in ({}, dict.fromkeys(range(60), 10**9)):
        bands, layout = ngramjoin._by_band(counts, 9, 10)
        for n in (1, 5, 9, 18, 19, 30, 47, 100, 333):
            for _ in range(6):
                a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
                drop = int(r.integers(0, n // 10 + 1))
                b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, int(r.integers(0, 3)), dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 10 * common < 9 * (len(a) + len(b) - common):
                    continue
                sigs = []
                for s in (a, b):
                    k = bands.index(len(s))
                    sigs.append(set(np.concatenate([ngramjoin.signatures(s, layout(q), q) for q in ((k, k - 1) if k else (k,))]).tolist()))
                assert sigs[0] & sigs[1]


def test_digests():
    assert decontam.items_digest(["1", "10"]) == hashlib.sha256(b"1,10").hexdigest()
