"""Helpers shared by the training-data operators.

Three things live here: work tables in the folder that all executors share, a
join that survives one key holding a large part of the rows, and numpy
routines that turn an Arrow text column into word and shingle hashes.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has over one 256th of the rows, so there are fewer than 256 hot keys.
HOT_KEYS = 256
#: No key of fewer rows is hot, however few rows there are.
FEW_ROWS = 100
#: Bytes of text that numpy handles at once inside a task.
SLICE_BYTES = 512 << 10

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
MUL = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- work tables


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors must share.

    Where it is unset a local session takes a temporary folder; a cluster fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/brindle-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write as Parquet and read back: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a work table that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Batches of ``n`` rows for Arrow functions that run meanwhile; for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that only finished, written steps have used.

    Spark's cleaner removes them once the driver has collected its garbage,
    which by default it may not do for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, limit: int = 250_000) -> DataFrame:
    """``df`` of a few numbers a row, marked for broadcast if it has ``limit`` rows at most; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------- hot keys


def hot_join(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of written tables on ``key``; ``right`` has each key once.

    ``size`` is right's column with the number of left rows of the key. Keys
    with over one 256th of all rows, of which fewer than 256 can exist, go by
    broadcast and move no left row; the rest go by an ordinary shuffle join.
    """
    total, largest = right.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if largest < FEW_ROWS or largest * HOT_KEYS <= total:
        return left.join(right, key)
    big = [r[0] for r in right.where(F.col(size) * HOT_KEYS > F.lit(total)).select(key).collect()]
    hot = F.col(key).isin(*[F.lit(k) for k in big])
    cold = left.where(~hot).join(right.where(~hot), key)
    return left.where(hot).join(F.broadcast(right.where(hot)), key).unionByName(cold)


# ------------------------------------------------------------- text in batches


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes.

    A null text is empty. A text longer than ``limit`` makes a run of its own.
    """
    arr = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    n = len(arr)
    if not n:
        return
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def lut(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes that separate words: blank, and tab to carriage return.
SPACE = lut((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes outside ``sep``; rows end words."""
    return spans_of(~sep[data], offsets)


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes that are ``inside``; rows end runs."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MUL)
_B = 0xD6E8FEB86659FD93
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in (("p", _B), ("q", pow(_B, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[k] = np.cumprod(x, dtype=np.uint64)
    return _POW["p"], _POW["q"]


def code_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of an array of code points."""
    return _spans(mix((code.astype(np.uint64) + np.uint64(1)) * MUL), starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    return _spans(BYTE[data], starts, ends)


def _spans(value: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Differences of the running sums of a polynomial over random values of the symbols."""
    p, q = _powers(len(value) + 1)
    run = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * p[: len(value)], dtype=np.uint64, out=run[1:])
    h = (run[ends] - run[starts]) * q[starts]
    return mix(h + (ends - starts).astype(np.uint64) * MUL)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position at which ``k`` words follow."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= MUL
        out += words[j : j + n]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each row, of lower-cased words.

    A row of one to ``k - 1`` words has its whole sequence as one shingle.
    """
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    g = gram_hashes(h, k)
    first = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(gram_hashes(h[a:b], b - a) if b > a else g[:0])
    return out


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one numpy array a row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))
