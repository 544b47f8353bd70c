"""Helpers shared by the training-data operators.

Conventions used by every operator of this folder:

* a null text counts as the empty text, a null id is carried through as null;
* only the id and text columns are read, so extra or clashing columns are harmless;
* repeated rows are separate documents (each gets its own result row);
* intermediate tables are written under ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    return written(df, name)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bounded_texts(docs: DataFrame, ids: list[int], most_bytes: int) -> list[tuple[int, str]]:
    """Texts of the ids, in order of a hash of the id, as many as stay within the bytes.

    ``ids`` is a bounded sample.  Sizes are read first, so that no more than ``most_bytes`` come to
    the driver; rows that repeat an id are one, the least of its texts, on the executors.
    """
    spark = docs.sparkSession

    def found(wanted: list[int]) -> DataFrame:
        rows = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
        return documents(docs).where("doc_id is not null").join(F.broadcast(rows), "doc_id").groupBy("doc_id")

    if not ids:
        return []
    size = {r["doc_id"]: r["n"] for r in found(ids).agg(F.max(F.octet_length("text")).alias("n")).collect()}
    total, chosen = 0, []
    for i in sorted(size, key=lambda i: (zlib.crc32(str(i).encode()), i)):
        if total + size[i] <= most_bytes:
            total += size[i]
            chosen.append(i)
    rows = found(chosen).agg(F.min("text").alias("text")).toArrow() if chosen else pa.table({"doc_id": [], "text": []})
    texts = dict(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True))
    return [(i, texts[i]) for i in chosen]


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id is not in ``gone(doc_id)``; null ids stay.  Columns of any name are kept."""
    key = unused(docs, "gone")
    return docs.join(gone.select(F.col("doc_id").alias(key)), F.col("doc_id") == F.col(key), "left_anti")


#: Bytes of a batch that goes to a worker at most; texts are long, and either side holds a batch more than once.
BATCH_BYTES = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to BATCH_BYTES, unless they are shorter already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """What this worker's allocators keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it likes
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; at its end the worker, which Spark keeps for other stages, gives its memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text in numpy

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER_BYTES = LOWER.tobytes()
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: The low bytes of a little-endian block, by how many of the word are in it.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at the row offsets."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    edge[0] = edge[n] = True
    return np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & edge[1:]) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising step of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: blocks of eight bytes enter one by one, each with a full mixing."""
    length = ends - starts
    out = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(starts):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    now = np.flatnonzero(length <= LONG_WORD)
    at, left = starts[now], length[now]
    while len(now):
        out[now] = mix(out[now] ^ mix(blocks[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        now, at, left = now[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out
