"""What the operators of this subpackage share: tables, the shared work folder and byte-level helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


#: Bytes of an Arrow batch: texts are long, and Spark's default by rows makes buffers of many times this in each task.
ARROW_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to what these operators work with at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = byte_size(spark.conf.get(key))
    if now > ARROW_BYTES or now <= 0:  # 0 and less stand for no bound
        spark.conf.set(key, str(ARROW_BYTES))


def byte_size(setting: str) -> int:
    """A size as Spark's settings state it: a number, with a unit or in bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", str(setting).lower()).groups()
    return int(number) << 10 * "kmgtp".find(unit[:1]) + 10 if unit.strip("b") else int(number)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, a temporary one, on a single machine only."""
    tune(spark)
    jsc = spark.sparkContext._jsc.sc()
    now = jsc.getCheckpointDir()
    if now.isDefined():
        return now.get()
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="foliant-")
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def work_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, held in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage, whereupon Spark deletes the shuffle files of frames that are held since."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a held frame that one task reads.
HELD_ROWS = 100_000


def held(df: DataFrame) -> DataFrame:
    """The same rows, held as `cut` does, and read by as many tasks as they need: few rows make few shuffle files."""
    df = cut(df)
    return df.coalesce(1 + df.count() // HELD_ROWS)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read by as many tasks as their bytes need.

    A checkpoint takes over the plan's estimate of its size, and an estimate is the product of the joined sides': where rounds of
    joins follow each other, its digits multiply with each until they fill the driver. Files have the size they have.
    """
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what `stored` wrote to a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Returns this Python worker's free memory to the machine, where the allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """run(batches), after which the worker, which lives on, holds no more than it must."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


_caches: dict[str, list] = {}


def cache_of(name: str) -> list:
    """What an operator keeps in a Python worker from task to task; the worker drops what other operators kept there."""
    for other in [k for k in _caches if k != name]:
        del _caches[other]
        gc.collect()
    return _caches.setdefault(name, [])


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes in `column`; a longer value stands alone, whole."""
    _, off, _ = raw(batch.column(column))
    n, at = len(off) - 1, 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + most, "right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets with one more than rows, valid) of a string or binary column; null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    n = len(col)
    off = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and n else np.empty(0, np.uint8)
    valid = np.asarray(col.is_valid()) if n else np.empty(0, bool)
    off = off - off[0]
    if col.null_count and (np.diff(off)[~valid] != 0).any():
        keep = np.repeat(valid, np.diff(off))
        off = np.concatenate([[0], np.cumsum(np.where(valid, np.diff(off), 0))])
        d = d[keep]
    return d, off, valid


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64 bits (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Rolling:
    """Polynomial hashes of substrings of a byte array, modulo 2**64, from prefix sums."""

    def __init__(self, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.codes = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 60)) * 8 + 5
        self._n = 0

    def _powers(self, n: int) -> None:
        if n > self._n:
            self._n = max(n, 1 << 16)
            self.up, self.down = np.full(self._n + 1, self.base, np.uint64), np.full(self._n + 1, _inverse(self.base), np.uint64)
            for a in (self.up, self.down):
                a[0] = 1
                np.cumprod(a, out=a)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.codes[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), the same for equal bytes at any place."""
        return mix(((prefix[end] - prefix[start]) * self.down[start]) + (end - start).astype(np.uint64) * _ODD)

    def every(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all windows of one width; as `of` gives."""
        n = len(prefix) - width
        return mix((prefix[width:] - prefix[:n]) * self.down[:n] + U64(width * int(_ODD) & MASK)) if n > 0 else np.empty(0, np.uint64)


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, count), one after another."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


REGIONS = 256
#: A bitmap has 16 bits or more for each entry, within these bounds (2**29 bits are 64 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29


@dataclass
class Bitmap:
    bits: int
    flat: np.ndarray

    def has(self, key: np.ndarray) -> np.ndarray:
        per = np.uint64(self.bits // REGIONS)
        region = (key & U64(REGIONS - 1)).astype(np.int64)
        at = ((key >> U64(8)) % per).astype(np.int64)
        return (self.flat[region * (self.bits // REGIONS // 8) + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame, most: int = MOST_BITS) -> Bitmap:
    """Of a column key (long, spread over all its bits). Built region by region where the keys are; only the bits go to the driver."""
    spark = keys.sparkSession
    keys = cut(keys.select("key"))
    n = keys.count()
    bits = int(min(most, max(LEAST_BITS, 1 << (16 * n).bit_length())))
    per = bits // REGIONS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            key = np.asarray(batch.column(0)).view(np.uint64)
            region = (key & U64(REGIONS - 1)).astype(np.int64)
            at = ((key >> U64(8)) % U64(per)).astype(np.int64)
            for r in np.unique(region).tolist():
                x = at[region == r]
                np.bitwise_or.at(made.setdefault(r, np.zeros(per // 8, np.uint8)), x >> 3, (1 << (x & 7)).astype(np.uint8))
        for r, b in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b.tobytes()])], ["region", "bits"])

    regions = [np.zeros(per // 8, np.uint8)] * REGIONS
    region = F.col("key").bitwiseAND(F.lit(REGIONS - 1)).cast("int")
    for r in keys.repartition(min(REGIONS, parts(spark)), region).mapInArrow(build, "region int, bits binary").toLocalIterator():
        regions[r.region] = np.frombuffer(r.bits, np.uint8)
    return Bitmap(bits, np.concatenate(regions))
