"""Token-ID output: length-delimited binary record files with masked checksums and a separate offset index.

File format (`part-NNNNN.rec`): for each record, in this order, all little-endian:
    length of the payload, unsigned 64 bits
    masked CRC-32C of those 8 bytes, unsigned 32 bits
    payload
    masked CRC-32C of the payload, unsigned 32 bits
The mask of a checksum c is ((c >> 15) | (c << 17)) + 0xA282EAD8 modulo 2**32, so that checksums of data which
hold checksums stay sound. The payload: 1 byte flags (1: no doc_id), 1 byte width of an id (2 or 4), 6 bytes zero,
doc_id (signed 64 bits), then the ids.
Index (`part-NNNNN.idx`): for each record 32 bytes: doc_id, offset in the record file, length of the payload,
number of ids, each a signed 64-bit integer. A shuffled reader opens the index alone, permutes it, and seeks.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import cache_of, parts, raw, slices, tidy, work_dir

MASK_DELTA = 0xA282EAD8
POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
BLOCK = 256  # bytes that the parallel checksum takes at a time


# ---- checksums -----------------------------------------------------------------------------------------------


def _tables() -> np.ndarray:
    """tables[k][b]: the register after byte b and then k zero bytes."""
    t = np.zeros((8, 256), np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (POLYNOMIAL if c & 1 else 0)
        t[0, b] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> 8) ^ t[0, t[k - 1] & 255]
    return t


_T = _tables()


def _advance(c: np.ndarray, n: int) -> np.ndarray:
    """The registers after n zero bytes."""
    for _ in range(n):
        c = (c >> np.uint32(8)) ^ _T[0, c & np.uint32(255)]
    return c


#: _SHIFT[i][b]: the register b << 8 * i after BLOCK zero bytes.
_SHIFT = np.stack([_advance(np.arange(256, dtype=np.uint32) << np.uint32(8 * i), BLOCK) for i in range(4)])


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each data[offsets[i]:offsets[i + 1]]; each part has 4 bytes at least.

    Inverting the first 4 bytes stands for the initial register, after which leading zeros change nothing: parts are
    padded in front to whole blocks, the blocks of all parts advance together, and a table combines them.
    """
    size = np.diff(offsets)
    blocks = -(-size // BLOCK)
    ends = np.cumsum(blocks)
    buf = np.zeros(int(ends[-1]) * BLOCK if len(ends) else 0, np.uint8)
    at = ends * BLOCK - size
    if len(size):
        buf[np.arange(len(data)) + np.repeat(at - offsets[:-1], size)] = data
        for k in range(4):
            buf[at + k] ^= 255
    words = buf.view("<u4").reshape(-1, BLOCK // 4)
    c = np.zeros(len(words), np.uint32)
    columns = np.ascontiguousarray(words.T)
    for k in range(0, BLOCK // 4, 2):
        x, y = columns[k] ^ c, columns[k + 1]
        c = _T[7, x & 255] ^ _T[6, (x >> 8) & 255] ^ _T[5, (x >> 16) & 255] ^ _T[4, x >> 24]
        c ^= _T[3, y & 255] ^ _T[2, (y >> 8) & 255] ^ _T[1, (y >> 16) & 255] ^ _T[0, y >> 24]
    first = ends - blocks
    out = c[first] if len(size) else np.empty(0, np.uint32)
    live = np.flatnonzero(blocks > 1)
    k = 1
    while len(live):
        x = out[live]
        out[live] = c[first[live] + k] ^ _SHIFT[0, x & 255] ^ _SHIFT[1, (x >> 8) & 255] ^ _SHIFT[2, (x >> 16) & 255] ^ _SHIFT[3, x >> 24]
        k += 1
        live = live[blocks[live] > k]
    return ~out


def masked(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(MASK_DELTA)


# ---- framing -------------------------------------------------------------------------------------------------


def frame(doc_ids: np.ndarray, null_id: np.ndarray, ids: np.ndarray, offsets: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Records of the id bytes ids[offsets[i]:offsets[i + 1]]: the file's bytes, and each record's offset and payload length."""
    n, size = len(doc_ids), np.diff(offsets) + 16
    ends = np.cumsum(size + 16)
    start = ends - size - 16
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        b = values.view(np.uint8).reshape(n, -1)
        for k in range(b.shape[1]):
            out[at + k] = b[:, k]

    length = size.astype("<u8")
    put(start, length)
    put(start + 8, masked(crc32c(length.view(np.uint8), np.arange(n + 1) * 8)).astype("<u4"))
    out[start + 12] = null_id
    out[start + 13] = width
    put(start + 20, np.where(null_id, 0, doc_ids).astype("<i8"))
    out[np.arange(len(ids)) + np.repeat(start + 28 - offsets[:-1], np.diff(offsets))] = ids
    payload = np.repeat(start + 12 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    put(start + 12 + size, masked(crc32c(out[payload], np.concatenate([[0], np.cumsum(size)]))).astype("<u4"))
    return out.tobytes(), start, size


class BadRecord(ValueError):
    """A record file is cut short or a checksum does not hold."""


#: Bytes of a file that are framed or read at a time; what places each byte takes many times as much memory.
PIECE = 1 << 20
#: Bytes that a long record is read by.
READ_AHEAD = 64 << 20


def records(stream, most: int = PIECE) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record; every checksum is verified. Holds about `most` bytes, or the longest record."""
    rest, wanted = b"", 0
    while True:
        got = stream.read(max(most, wanted, 1))
        rest += got
        buf, at, found, wanted = np.frombuffer(rest, np.uint8), 0, [], 0
        while len(rest) - at >= 12:
            n = int.from_bytes(rest[at : at + 8], "little")
            if n > 1 << 40:
                raise BadRecord("a length is out of range")
            if len(rest) - at < n + 16:
                wanted = min(n + 16 - (len(rest) - at), READ_AHEAD)  # a long record is not put together from many small reads
                break
            found.append((at, n))
            at += n + 16
        if found:
            start, size = np.array([x[0] for x in found]), np.array([x[1] for x in found])
            k = len(found)
            heads = buf[(start[:, None] + np.arange(8)).ravel()]
            ends = np.concatenate([[0], np.cumsum(size)])
            body = buf[np.arange(int(ends[-1])) + np.repeat(start + 12 - ends[:-1], size)]

            def stored(where: np.ndarray) -> np.ndarray:
                return np.ascontiguousarray(buf[where[:, None] + np.arange(4)]).view("<u4").ravel()

            if (size < 16).any() or (masked(crc32c(heads, np.arange(k + 1) * 8)) != stored(start + 8)).any() or (masked(crc32c(body, ends)) != stored(start + 12 + size)).any():
                raise BadRecord("a checksum does not hold")
            for i in range(k):
                p = body[ends[i] : ends[i + 1]]
                yield (None if p[0] else int.from_bytes(p[8:16].tobytes(), "little", signed=True)), p[16:].view(f"<u{int(p[1])}")
            rest = rest[at:]
        if not got:
            if rest:
                raise BadRecord("the file ends inside a record")
            return


# ---- encoding ------------------------------------------------------------------------------------------------


#: Alternatives of a split pattern, none of which can match white space; a pattern of these alone never joins two words.
_WITHIN = {r"[\p{L}]+", r"\p{L}+", r"[\p{N}]", r"\p{N}", r"[\p{N}]+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
#: A word that stands between others when many are encoded as one text.
_BETWEEN = "\x01"
#: Letters of Latin-1, whose small forms every rule agrees on, and perhaps one mark after them: two tokens of the split.
_MARKS = [".", ",", ";", ":", "!", "?"]
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?$"
#: Words that are encoded as one text.
_TOGETHER = 200


def words_alone(path: str) -> bool:
    """Whether the tokenizer's file proves that the words between ASCII white space encode alone, whatever stands around them.

    So it is if: the normalizer has only steps that act within a word (NFC joins nothing with white space) or on white
    space; the pre-tokenizer drops what its pattern doesn't match, and no alternative of that pattern matches white space;
    no added token has white space or looks at its neighbours; nothing is added after; and the model is BPE without dropout.
    """
    with open(path, encoding="utf-8") as f:
        form = json.load(f)

    def steps(x: dict | None, inner: str) -> list[dict]:
        return [] if x is None else [z for y in x[inner] for z in steps(y, inner)] if x["type"] == "Sequence" else [x]

    def within(step: dict) -> bool:
        return step["type"] in ("NFC", "Lowercase") or (step["type"], step.get("pattern"), step.get("content")) == ("Replace", {"Regex": r"\s+"}, " ")

    pre = steps(form.get("pre_tokenizer"), "pretokenizers")
    if len(pre) != 2 or not all(map(within, steps(form.get("normalizer"), "normalizers"))):
        return False
    cut, after = pre
    pattern = str((cut.get("pattern") or {}).get("Regex", " "))
    if cut["type"] != "Split" or (cut["behavior"], cut["invert"]) != ("Removed", True) or not set(pattern.split("|")) <= _WITHIN:
        return False
    if after["type"] != "ByteLevel" or after["add_prefix_space"] or after["use_regex"]:
        return False
    tokens = form.get("added_tokens") or []
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] or x["content"].split() != [x["content"]] for x in tokens):
        return False
    return form.get("post_processor") is None and form["model"]["type"] == "BPE" and not form["model"].get("dropout")


class Encoder:
    """Ids of whole texts. Where the tokenizer's file proves that words encode alone, each distinct word of a slice is encoded once."""

    def __init__(self, path: str, end_id: int):
        # threads of the library's own would each keep an arena, and a task has one core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.width = 2 if max(self.t.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind)
        between = self.t.encode(_BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if words_alone(path) and len(between) == 1 else None
        self.plain = self._plain(path) if self.between is not None else None
        self.marks = pa.array([np.array(self.t.encode(c, add_special_tokens=False).ids, self.kind).tobytes() for c in _MARKS] + [b""], pa.large_binary())

    def _plain(self, path: str) -> tuple | None:
        """The steps that are left for small letters, and all steps, for a model that marks the ends of words."""
        from tokenizers import normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        suffix, pattern = form["model"].get("end_of_word_suffix"), form["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].split("|")
        lowers = any(x["type"] == "Lowercase" for x in (form.get("normalizer") or {}).get("normalizers", []))
        if not suffix or not lowers or not {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(pattern):
            return None
        self.last = np.zeros(self.t.get_vocab_size(), bool)
        self.last[[k for w, k in form["model"]["vocab"].items() if w.endswith(suffix)]] = True
        split = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return (normalizers.Sequence([]), split), (self.t.normalizer, self.t.pre_tokenizer)

    def encode(self, texts: pa.Array) -> pa.Array:
        """Id bytes of each text (null: empty), with the end id."""
        if self.between is None:
            made = self.t.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            ids = [np.append(np.array(e.ids, self.kind), self.end).tobytes() for e in made]
            return pa.array(ids, pa.large_binary())
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        off = np.asarray(split.offsets).astype(np.int64)
        words = split.flatten().dictionary_encode()
        del split  # its words are in the dictionary, and what follows takes more memory
        # each text's words, then one more entry of the dictionary: the end id
        n = len(texts)
        which = np.full(int(off[-1] - off[0]) + n, len(words.dictionary), np.int32)
        own = np.ones(len(which), bool)
        own[off[1:] - off[0] + np.arange(n)] = False
        which[own] = np.asarray(words.indices)
        words = words.dictionary
        ids = self._words(words).take(pa.array(which))
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(which) + 1][off - off[0] + np.arange(n + 1)]
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(ends)), data])

    def _words(self, words: pa.Array) -> pa.Array:
        """Id bytes of each word, and of the end id. Letters with a mark at most after them share their letters' ids."""
        plain = np.asarray(pc.match_substring_regex(words, _PLAIN)) if self.plain else np.zeros(len(words), bool)
        some = pc.utf8_lower(words.filter(pa.array(plain)))
        letters = pc.utf8_rtrim(some, "".join(_MARKS))
        marks = pc.index_in(pc.utf8_slice_codeunits(some, -1), pa.array(_MARKS, some.type)).fill_null(len(_MARKS))
        letters = letters.dictionary_encode()
        made = pc.binary_join_element_wise(self._letters(letters.dictionary).take(letters.indices), self.marks.take(marks), pa.scalar(b"", pa.large_binary()))
        rest = self._others(words.filter(pa.array(~plain)))
        where = np.empty(len(words) + 1, np.int64)
        where[:-1][plain], where[:-1][~plain] = np.arange(len(made)), np.arange(len(rest)) + len(made)
        where[-1] = len(made) + len(rest)
        return pa.concat_arrays([made, rest, self._packed(self.end, np.ones(1, np.int64))]).take(pa.array(where))

    def _packed(self, ids: np.ndarray, size: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(size * self.width)])
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])

    def _flat(self, texts: Iterable[str]) -> np.ndarray:
        """Ids of all texts, one after another; few at a time, as what the library returns is much larger than the ids."""
        made = [np.array(e.ids, self.kind) for some in batched(texts, 16) for e in self.t.encode_batch_fast(list(some), add_special_tokens=False)]
        return np.concatenate(made) if made else np.empty(0, self.kind)

    def _letters(self, words: pa.Array) -> pa.Array:
        """Words of small letters: each is one token of the split, whose last id ends a word."""
        few, all_steps = self.plain
        self.t.normalizer, self.t.pre_tokenizer = few
        try:
            ids = self._flat(" ".join(many) for many in _few(words))
        finally:
            self.t.normalizer, self.t.pre_tokenizer = all_steps
        return self._packed(ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))

    def _others(self, words: pa.Array) -> pa.Array:
        apart = np.asarray(pc.match_substring(words, _BETWEEN))
        ids = self._flat(f" {_BETWEEN} ".join(many) + f" {_BETWEEN}" for many in _few(words.filter(pa.array(~apart))))
        stop = ids == self.between
        made = self._packed(ids[~stop], np.diff(np.flatnonzero(stop), prepend=-1) - 1)
        own = [np.array(self.t.encode(w, add_special_tokens=False).ids, self.kind).tobytes() for w in words.filter(pa.array(apart)).to_pylist()]
        where = np.empty(len(words), np.int64)
        where[~apart], where[apart] = np.arange(len(made)), np.arange(len(own)) + len(made)
        return pa.concat_arrays([made, pa.array(own, pa.large_binary())]).take(pa.array(where))


def _few(words: pa.Array) -> Iterator[list[str]]:
    """Words that are encoded as one text, as Python strings, which take many times the words' memory."""
    return (words.slice(k, _TOGETHER).to_pylist() for k in range(0, len(words), _TOGETHER))


def _encoder(path: str, end_id: int) -> Encoder:
    kept = cache_of("tokens")
    if not kept or kept[0] != (path, end_id):
        kept[:] = [(path, end_id), Encoder(path, end_id)]
    return kept[1]


#: Bytes of text that are encoded at a time; a longer text stands alone.
SLICE = 4 << 20


@dataclass(frozen=True)
class Layout:
    """Parts of an order by (doc_id, null first, a hash of the record): between neighbouring edges of doc_id one part, or, where an id has very many rows, several."""

    edges: np.ndarray  # of doc_id, ascending; an id belongs below the first edge that is not less
    shares: np.ndarray  # parts of null, and of each place between edges

    def parts(self, doc_id: np.ndarray, valid: np.ndarray, tie: np.ndarray) -> np.ndarray:
        place = np.where(valid, np.searchsorted(self.edges, doc_id) + 1, 0)
        first = np.concatenate([[0], np.cumsum(self.shares)])
        return first[place] + ((tie >> 31) * self.shares[place] >> 32)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", layout: Layout | None = None) -> DataFrame:
    """Rows (part, doc_id, tie, ids): ids is binary, little-endian, 2 bytes an id if the vocabulary allows, else 4; tie is a hash of it.

    Null text counts as empty; part is that of the layout (none: 0).
    """
    layout = layout or Layout(np.empty(0, np.int64), np.ones(2, np.int64))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(tokenizer, end_id)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = e.encode(part.column(1)).cast(pa.binary())
                doc = part.column(0)
                tie = np.array([xxhash.xxh64_intdigest(x.as_buffer()) >> 1 for x in ids], np.int64)
                where = layout.parts(np.asarray(doc.fill_null(0)), np.asarray(doc.is_valid()), tie)
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), doc, pa.array(tie), ids], ["part", "doc_id", "tie", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "part int, doc_id long, tie long, ids binary")


# ---- files ---------------------------------------------------------------------------------------------------

def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


#: Bytes of input, as Spark estimates it, for each part at least where it is large.
PART_BYTES = 256 << 20


def part_count(docs: DataFrame) -> int:
    """Parts to write: as many as shuffles have, or more for large inputs."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts(docs.sparkSession), size // PART_BYTES if size < 1 << 56 else 1)  # beyond that the size is not known


def layout_of(docs: DataFrame, n: int, id_col: str = "doc_id") -> Layout:
    """About n parts of about as many rows each; reads the ids alone. An id, or null, with more rows than that has several."""
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    cuts = ids.agg(F.percentile_approx("i", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    share = max(1, -(-ids.count() // n))
    hot = {r.i: -(-r["count"] // share) for r in ids.groupBy("i").count().where(F.col("count") > share).collect()}  # fewer than n
    alone = [i for i in hot if i is not None]
    edges = np.array(sorted({*(cuts or []), *alone, *(i - 1 for i in alone if i > -(1 << 63))}), np.int64)
    shares = np.ones(len(edges) + 2, np.int64)
    for i, k in hot.items():
        shares[0 if i is None else int(np.searchsorted(edges, i)) + 1] = k
    return Layout(edges, shares)


def write_records(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> tuple[str, list[Row]]:
    """Encodes every whole text and writes record files and their indexes to `path`, a folder that all machines share.

    Ascending doc_id, first within a file and then from file to file; null doc_id comes first, rows of one doc_id are
    ordered by a hash of their ids, and by the ids' bytes where that is equal. An id with very many rows, or null, is dealt to
    several files by that hash; rows that are equal in all share one. Null text counts as empty and gives the end id alone. An empty table gives no file.
    Other columns are ignored. A file is written under a name of its own try and renamed when complete, so a task may run twice.
    Returns the folder and one row for each file (part, records, ids, bytes).
    """
    spark = docs.sparkSession
    path = path or work_dir(spark, "tokens")
    layout = layout_of(docs, partitions or part_count(docs), id_col)
    width = _encoder(tokenizer, end_id).width

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(path)
        made = None
        for batch in batches:
            for part in slices(batch, "ids", PIECE):
                if not part.num_rows:
                    continue
                if made is None:
                    k = part.column("part")[0].as_py()
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/part-{k:05d}"
                    tries = [f"{base}/_{uuid.uuid4().hex}.{x}" for x in ("rec", "idx")]
                    outs = [fs.open_output_stream(t) for t in tries]
                    made = [k, 0, 0, 0]
                data, off, _ = raw(part.column("ids"))
                doc = part.column("doc_id")
                ids = np.asarray(doc.fill_null(0))
                got, at, size = frame(ids, ~np.asarray(doc.is_valid()), data, off, width)
                outs[0].write(got)
                outs[1].write(np.stack([ids, at + made[3], size, np.diff(off) // width], 1).astype("<i8").tobytes())
                made = [made[0], made[1] + len(ids), made[2] + len(data) // width, made[3] + len(got)]
        if made:
            for t, o, x in zip(tries, outs, ("rec", "idx"), strict=True):
                o.close()
                fs.move(t, f"{name}.{x}")
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "records", "ids", "bytes"])

    rows = encoded(docs, tokenizer, end_id, id_col, text_col, layout).repartitionById(int(layout.shares.sum()), F.col("part"))
    made = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "ids").mapInArrow(write, "part int, records long, ids long, bytes long")
    return path, sorted(made.collect())  # a row for each file


def read_records(spark: SparkSession, path: str, manifest: list[Row]) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, part, record) of all record files, each checksum verified.

    start counts the ids of all documents before, over all files.
    """
    files, total = [], 0
    for r in manifest:
        files.append((r.part, total))
        total += r.ids

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(path)
        for batch in batches:
            for k, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/part-{k:05d}.rec") as f:
                    rows = []
                    for i, (doc, ids) in enumerate(records(f)):
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), k, i))
                        start += len(ids)
                        if len(rows) >= 20_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, record long"
    if not files:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(files, "part int, start long").repartition(len(files)).mapInArrow(read, schema)


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("record", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def shuffled(fs: pafs.FileSystem, base: str, part: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of one file's records in an order given by the seed: a permutation of the index, then seeks."""
    index = np.frombuffer(fs.open_input_stream(f"{base}/part-{part:05d}.idx").read(), "<i8").reshape(-1, 4)
    with fs.open_input_file(f"{base}/part-{part:05d}.rec") as f:
        for k in np.random.default_rng(seed).permutation(len(index)):
            f.seek(int(index[k, 1]))
            yield from records(_Once(f.read(int(index[k, 2]) + 16)))


class _Once:
    def __init__(self, data: bytes):
        self.data = data

    def read(self, _: int) -> bytes:
        data, self.data = self.data, b""
        return data
