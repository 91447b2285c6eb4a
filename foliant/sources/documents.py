"""Documents as rows: files in, node tables and converted files out."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.doc import read_doc
from foliant.functions.docx import read_docx, write_docx
from foliant.functions.formats import load_format, reader_of
from foliant.functions.markdown import read_markdown, read_text
from foliant.functions.markdown_out import write_markdown
from foliant.functions.model import INLINES, PARAGRAPHS, Document, inline_rows, paragraph_rows
from foliant.functions.pdf import write_pdf

RAW = "doc_id string, path string, format string, content binary"
#: Node rows, or bytes of made files, that go to Spark at a time.
ROWS, BYTES = 10_000, 8 << 20


class UnsupportedFormat(ValueError):
    """No reader or writer takes this format."""


def read_documents(spark: SparkSession, path: str, load_format_name: str | None = None, **options: str) -> DataFrame:
    """Files below a path as raw documents (doc_id, path, format, content)."""
    files = spark.read.format("binaryFile").options(**{"recursiveFileLookup": "true"} | options).load(path)
    return raw_documents(files.withColumn("doc_id", F.col("path")), load_format_name)


def raw_documents(files: DataFrame, load_format_name: str | None = None) -> DataFrame:
    """Rows (doc_id, path, content) with the format that reads each."""
    explicit = load_format(F.lit(load_format_name))
    return files.withColumn("format", reader_of(F.col("path"), F.col("content"), explicit)).select("doc_id", "path", "format", "content")


def text_documents(texts: DataFrame, fmt: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts in a column as raw documents."""
    return texts.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("string").alias("path"), F.lit(fmt).alias("format"), F.col(text_col).cast("binary").alias("content"))


def load(fmt: str, content: bytes, encoding: str = "utf-8", keep_empty: bool = False) -> Document:
    if fmt == "docx":
        return read_docx(content)
    if fmt == "markdown":
        return read_markdown(content.decode(encoding, "replace"), keep_empty)
    if fmt == "text":
        return read_text(content.decode(encoding, "replace"))
    if fmt in ("doc", "rtf"):
        return read_doc(content)
    raise UnsupportedFormat(f"no reader for {fmt}")


def save(doc: Document, to: str, **options) -> bytes:
    if to == "markdown":
        return write_markdown(doc, **options).encode()
    if to == "text":
        return doc.text.encode()
    if to == "docx":
        return write_docx(doc, **options)
    if to == "pdf":
        return write_pdf(doc, **options)
    raise UnsupportedFormat(f"no writer for {to}")


def _spread(raw: DataFrame) -> DataFrame:
    """The same rows over all cores: parsing takes far longer than reading, and few bytes, a small table say, come as one task."""
    spark = raw.sparkSession
    return raw.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _nodes(raw: DataFrame, schema: str, rows, **options) -> DataFrame:
    """Node rows of each document; one that can't be read gives one row with its error."""
    kind = raw.schema["doc_id"].dataType.simpleString()
    out = raw.sparkSession.createDataFrame([], f"doc_id {kind}, {schema}, error string").schema
    arrow = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, fmt, content = (batch.column(c)[k].as_py() for c in ("doc_id", "format", "content"))
                try:
                    made += [{"doc_id": doc_id, **r} for r in rows(load(fmt, content or b"", **options))]
                except Exception as e:  # noqa: BLE001  a broken document is a row, not a failed job
                    made.append({"doc_id": doc_id, "error": f"{type(e).__name__}: {e}"})
                if len(made) >= ROWS:
                    yield from (pa.RecordBatch.from_pylist(made[at : at + ROWS], arrow) for at in range(0, len(made), ROWS))
                    made = []
        yield pa.RecordBatch.from_pylist(made, arrow)

    return _spread(raw.select("doc_id", "format", "content")).mapInArrow(run, out)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def paragraphs(raw: DataFrame, **options) -> DataFrame:
    return _nodes(raw, PARAGRAPHS, paragraph_rows, **options)


def inlines(raw: DataFrame, **options) -> DataFrame:
    return _nodes(raw, INLINES, inline_rows, **options)


def list_levels(raw: DataFrame, **options) -> DataFrame:
    rows = lambda d: [{"list_id": k, "level": n, "number_style": x.number_style, "number_format": x.number_format, "start_at": x.start_at} for k, levels in d.lists.items() for n, x in enumerate(levels)]
    return _nodes(raw, "list_id int, level int, number_style int, number_format string, start_at int", rows, **options)


def styles(raw: DataFrame, **options) -> DataFrame:
    rows = lambda d: [{"ord": n, "name": k, "base_style_name": v} for n, (k, v) in enumerate(d.styles.items())]
    return _nodes(raw, "ord int, name string, base_style_name string", rows, **options)


def convert(raw: DataFrame, to: str, load_options: dict | None = None, **options) -> DataFrame:
    """(doc_id, content, error): each document in another format; one that fails has an error instead of content."""
    kind = raw.schema["doc_id"].dataType.simpleString()
    if to not in ("markdown", "text", "docx", "pdf"):
        raise UnsupportedFormat(f"no writer for {to}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            made, size, since = [], 0, 0
            for k in range(batch.num_rows):
                fmt, content = (batch.column(c)[k].as_py() for c in ("format", "content"))
                out, error = None, None
                try:
                    out = save(load(fmt, content or b"", **load_options or {}), to, **options)
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                made.append((out, error))
                size += len(out or b"")
                if size > BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(since, len(made)), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], ["doc_id", "content", "error"])
                    made, size, since = [], 0, k + 1

    return _spread(raw.select("doc_id", "format", "content")).mapInArrow(run, f"doc_id {kind}, content binary, error string")


def write_files(converted: DataFrame, folder: str, suffix: str) -> DataFrame:
    """One file for each row in a folder that all machines share, complete when it has its name.

    The name is the end of doc_id with other characters than letters, digits, - and _ as _, and a digest of the whole
    doc_id, so different ids never share a file; rows that repeat an id also have their number, in the order of their contents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        for batch in batches:
            names = []
            for doc_id, content, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "content", "n")), strict=True):
                digest = hashlib.sha256(repr(doc_id).encode("utf-8", "surrogatepass")).hexdigest()[:32]
                name = "".join(c if c.isalnum() or c in "-_" else "_" for c in str(doc_id))[-40:] + f"-{digest}" + (f"-{n}" if n > 1 else "") + suffix
                with fs.open_output_stream(f"{base}/_{(tmp := uuid.uuid4().hex)}", compression=None) as o:
                    o.write(content)
                fs.move(f"{base}/_{tmp}", f"{base}/{name}")
                names.append(name)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string())], ["doc_id", "file"])

    kind = converted.schema["doc_id"].dataType.simpleString()
    same = W.partitionBy("doc_id").orderBy(F.sha2("content", 256))
    rows = converted.where("content is not null").select("doc_id", "content").withColumn("n", F.row_number().over(same))
    return rows.mapInArrow(run, f"doc_id {kind}, file string")
