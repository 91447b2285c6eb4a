"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Each response gives a `metadata` record (JSON: the source's headers, its HTTP headers, title, links, digests) and a
`conversion` record (text/plain), both with WARC-Refers-To the response, its target URI and date, its payload digest as
WARC-Refers-To-Payload-Digest, and a digest of their own block. Files: one gzip member for each record.
"""

from __future__ import annotations

import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import slices, tidy, work_dir
from .htmlmain import RAW, bare, events

#: Namespace of the ids that are derived from a source id, so that a rerun gives the same ids.
SPACE = uuid.UUID("6f1c2a34-90d5-5d0c-8a53-3b9d2c1f7e10")
HEADERS = "array<struct<name:string,value:string>>"
Headers = list[tuple[str, str]]


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base 32 by two letters at a time.
_PAIRS = [a + b for a in _LETTERS for b in _LETTERS]


def digest(data: bytes) -> str:
    n = int(hashlib.sha1(data).hexdigest(), 16)
    return "sha1:" + "".join([_PAIRS[n >> k & 1023] for k in range(150, -10, -10)])


def derived_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, kind + ' ' + source)}>"


def value(headers: Headers, name: str) -> str | None:
    return next((v for n, v in headers if n.lower() == name.lower()), None)


def record(headers: Headers, block: bytes) -> bytes:
    """One record as a gzip member; Content-Length is set here."""
    flat = lambda v: re.sub(r"[\r\n]+", " ", v) if "\n" in v or "\r" in v else v
    lines = ["WARC/1.1", *[f"{n}: {flat(v)}" for n, v in headers if n.lower() != "content-length"], f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def read(stream, most: int = 1 << 20) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record of a stream of gzip members."""
    rest, z, body = b"", zlib.decompressobj(31), bytearray()
    while True:
        if not rest:
            rest = stream.read(most)
            if not rest:
                if body:
                    raise ValueError("the file ends inside a record")
                return
        body += z.decompress(rest)
        rest = z.unused_data
        if z.eof:
            head, _, tail = bytes(body).partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = [(n, v.strip()) for n, _, v in (x.partition(":") for x in lines[1:])]
            yield headers, tail[: int(value(headers, "Content-Length") or 0)]
            z, body = zlib.decompressobj(31), bytearray()


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records (headers, block). Null url gives no WARC-Target-URI, null html an empty payload."""
    fields = [("WARC-Type", F.lit("response")), ("WARC-Source-Row", F.col(id_col).cast("string")), ("WARC-Target-URI", F.col(url_col).cast("string")), ("WARC-Date", F.lit(date)), ("Content-Type", F.lit("application/http; msgtype=response"))]
    headers = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in fields]), lambda h: h["value"].isNotNull())
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(headers.alias("headers"), F.concat(http.cast("binary"), body).alias("block"))


def plain(page: str) -> tuple[str, str, list[str]]:
    """(title, text with a line for each block, link targets) of a page; scripts and styles are left out."""
    title, lines, links = "", [[]], []
    for kind, e, text in events(page, bare):
        if kind == "open":
            if e.name == "title":
                lines.append([])
        elif kind == "break":
            lines.append([])
        elif e.name == "title":
            title = title or " ".join(html.unescape(text).split())
        elif e.name not in RAW and e.name != "noscript":
            lines[-1].append(html.unescape(text))
    links = [html.unescape(x or y or z) for x, y, z in re.findall(r"""<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", page, re.I)]
    return title, "\n".join(t for x in lines if (t := " ".join("".join(x).split()))), links


def dechunked(data: bytes) -> bytes:
    """The body of a chunked transfer, as far as its chunks are whole and well formed."""
    out, at = bytearray(), 0
    while (end := data.find(b"\r\n", at)) >= 0 and (m := re.match(rb"[0-9A-Fa-f]+", data[at:end])):
        size = int(m[0], 16)
        if not size or size > len(data):
            break
        out += data[end + 2 : end + 2 + size]
        at = end + 2 + size + 2
    return bytes(out)


#: Bytes that a compressed body may have when it is whole; a longer one stays as it is, with its coding.
MOST_BYTES = 256 << 20


def inflated(data: bytes, bits: int) -> bytes:
    """All members of a compressed body, one after another; what follows the last and is none is left out."""
    out, size = [], 0
    while data:
        z = zlib.decompressobj(bits)
        try:
            part = z.decompress(data, MOST_BYTES - size + 1)
        except zlib.error:
            if out:
                break
            raise
        size += len(part)
        if size > MOST_BYTES:
            raise zlib.error("too long")
        out.append(part)
        data = z.unused_data if z.eof else b""
    return b"".join(out)


def decoded(payload: bytes, http: Headers) -> tuple[bytes, str]:
    """The entity of an HTTP body, and the coding that it is still in, if that is unknown or doesn't hold."""
    if "chunked" in (value(http, "Transfer-Encoding") or "").lower() and re.match(rb"[0-9A-Fa-f]+[^\r\n]{0,99}\r\n", payload):
        payload = dechunked(payload)
    for coding in reversed([c.strip().lower() for c in (value(http, "Content-Encoding") or "").split(",") if c.strip()]):
        if coding == "identity":
            continue
        for bits in {"gzip": (47,), "x-gzip": (47,), "deflate": (15, -15)}.get(coding, ()):
            try:
                payload = inflated(payload, bits)
                break
            except zlib.error:
                continue
        else:
            return payload, coding
    return payload, ""


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of one response; of another kind of record, none.

    Headers stay as they stand: in order, repeated ones too. Digests are those of the payload as it was sent; chunked
    transfers and gzip or deflate codings are undone for the text, all members of them; another coding gives no text, nor does a
    body of more than MOST_BYTES. The charset is that of the header, else of the page's own meta element, else UTF-8.
    """
    if (value(headers, "WARC-Type") or "") != "response":
        return []
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        head, payload = b"", block
    status, *fields = head.decode("latin-1").split("\r\n")
    http = [(n.strip(), v.strip()) for n, _, v in (f.partition(":") for f in fields)]
    entity, undecoded = decoded(payload, http)
    charset = re.search(r"charset=[\"']?([\w-]+)", next((f for f in fields if f.lower().startswith("content-type")), ""), re.I)
    # a page may name its charset itself, near its top
    own_set = re.search(rb"<meta[^>]{0,200}charset=[\"']?([\w-]+)", entity[:1024], re.I)
    try:
        page = entity.decode(charset[1] if charset else own_set[1].decode("latin-1") if own_set else "utf-8", "replace")
    except LookupError:
        page = entity.decode("utf-8", "replace")
    page = "" if undecoded else page
    own = value(headers, "WARC-Record-ID") or derived_id("response", f"{value(headers, 'WARC-Source-Row')} {value(headers, 'WARC-Target-URI')} {digest(payload)}")
    title, text, links = plain(page)
    payload_digest = value(headers, "WARC-Payload-Digest") or digest(payload)
    shared = [("WARC-Refers-To", own), *((n, v) for n in ("WARC-Target-URI", "WARC-Date", "WARC-Source-Row") if (v := value(headers, n)) is not None), ("WARC-Refers-To-Payload-Digest", payload_digest)]
    envelope = {
        "WARC-Header-Metadata": [*([n, v] for n, v in headers), *([] if value(headers, "WARC-Record-ID") else [["WARC-Record-ID", own]])],
        "Block-Digest": value(headers, "WARC-Block-Digest") or digest(block),
        "Payload-Digest": payload_digest,
        "HTTP-Response-Metadata": {"Status": status, "Headers": [[n, v] for n, v in http], "Entity-Length": len(entity), "Undecoded": undecoded},
        "HTML-Metadata": {"Title": title, "Links": links},
    }
    out = []
    for kind, mime, body in (("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")), ("conversion", "text/plain", text.encode("utf-8", "surrogatepass"))):
        out.append(([("WARC-Type", kind), ("WARC-Record-ID", derived_id(kind, own)), *shared, ("Content-Type", mime), ("WARC-Block-Digest", digest(body))], body))
    return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def build(records: DataFrame, path: str | None = None, most: int = 128 << 20) -> tuple[str, list[Row]]:
    """Writes the derivatives of response records (headers, block) to `path`, a folder that all machines share.

    Files are made where the records are read, without a shuffle, a new one after `most` bytes; `*.wat.gz` hold metadata,
    `*.wet.gz` conversions, in the same order. Records that are not responses, and null blocks as empty ones, are defined:
    the former are left out. A file is named by its task's part and number, and gets that name when complete, so a task that
    runs twice leaves one. Returns the folder and one row a pair of files (name, records).
    """
    path = path or work_dir(records.sparkSession, "warc")

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(path)
        task, own, made = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        state: list = []

        def close() -> pa.RecordBatch:
            name, n, outs, _ = state
            for kind, o in outs.items():
                o.close()
                fs.move(f"{base}/_{own}-{name}.{kind}.gz", f"{base}/{name}.{kind}.gz")
            state.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "records"])

        for batch in batches:
            for part in slices(batch, "block", 8 << 20) if batch.num_rows else []:
                for headers, block in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for h, b in derive([(x["name"], x["value"] or "") for x in headers or []], block or b""):
                        if not state:
                            fs.create_dir(base, recursive=True)
                            name = f"part-{task:05d}-{made:04d}"
                            made += 1
                            state[:] = [name, 0, {k: fs.open_output_stream(f"{base}/_{own}-{name}.{k}.gz", compression=None) for k in ("wat", "wet")}, 0]
                        kind = "wat" if h[0][1] == "metadata" else "wet"
                        data = record(h, b)
                        state[2][kind].write(data)
                        state[1] += kind == "wet"
                        state[3] += len(data)
                    if state and state[3] > most:
                        yield close()
        if state:
            yield close()

    return path, records.select("headers", "block").mapInArrow(write, "name string, records long").collect()


def read_pairs(spark: SparkSession, path: str, files: list[Row]) -> DataFrame:
    """One row for each response: its id, both derived ids, what they say of it, and the text; digests are verified."""
    schema = "source string, url string, response_id string, metadata_id string, conversion_id string, payload_digest string, metadata_digest string, conversion_digest string, title string, n_links long, text string"
    if not files:
        return spark.createDataFrame([], schema)
    names = [f.strip() for f in re.sub(r"\b(string|long)\b", "", schema).split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/{name}.wat.gz", compression=None) as a, fs.open_input_stream(f"{base}/{name}.wet.gz", compression=None) as b:
                    for (h, meta), (g, text) in zip(read(a), read(b), strict=True):
                        if value(h, "WARC-Refers-To") != value(g, "WARC-Refers-To") or digest(meta) != value(h, "WARC-Block-Digest") or digest(text) != value(g, "WARC-Block-Digest"):
                            raise ValueError("records do not fit together")
                        e = json.loads(meta)["Envelope"]
                        rows.append((value(h, "WARC-Source-Row"), value(h, "WARC-Target-URI"), value(h, "WARC-Refers-To"), value(h, "WARC-Record-ID"), value(g, "WARC-Record-ID"), e["Payload-Digest"], value(h, "WARC-Block-Digest"), value(g, "WARC-Block-Digest"), e["HTML-Metadata"]["Title"], len(e["HTML-Metadata"]["Links"]), text.decode("utf-8", "replace")))
                        size += len(text)
                        if size > 4 << 20:
                            yield _batch(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return spark.createDataFrame([(f.name,) for f in files], "name string").repartition(len(files)).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "n_links" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def members(data: bytes) -> list[tuple[Headers, bytes]]:
    return list(read(io.BytesIO(data)))
