"""Questions from chunks of documents to hash buckets, and the answers back.

Corpus statistics over billions of small items (substrings, n-grams) cost too much as rows.  Here a
row is a chunk of documents, compressed, and a message is a packed array: a chunk sends each bucket
one message with its distinct items, a bucket sees the messages of all chunks and answers each in
the order of its items.  An item of any frequency is one entry from each chunk.  The chunks are a
table in the shared folder, so a lost executor repeats only its own tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, shuffle_partitions, staged, text_buffer, tidy

#: Text bytes of a chunk (a longer document has its own), and of a bucket at least.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 6 << 20

CHUNK = "chunk string, ids binary, nulls binary, sizes binary, n_bytes long, payload binary"
_CHUNK = pa.schema([("chunk", pa.string()), ("ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("n_bytes", pa.int64()), ("payload", pa.binary())])


def _pack_batches(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def chunk(rows: pa.Table) -> pa.RecordBatch:
        raw, offsets = text_buffer(rows.column("text"))
        ids = rows.column("doc_id").combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        values = np.array(ids.fill_null(np.iinfo(np.int64).max), np.int64)
        payload = zstandard.ZstdCompressor(level=3).compress(raw.tobytes())
        return pa.RecordBatch.from_pylist([{"chunk": uuid.uuid4().hex, "ids": values.tobytes(), "nulls": np.packbits(np.array(ids.is_null())).tobytes(), "sizes": np.diff(offsets).astype(np.int64).tobytes(), "n_bytes": int(offsets[-1]), "payload": payload}], _CHUNK)

    for batch in batches:
        _, offsets = text_buffer(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + chunk_bytes - size, "right")) - 1
            to = min(batch.num_rows, max(to, at + (not held)))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(offsets[to] - offsets[at])
                at = to
            if at < batch.num_rows:
                yield chunk(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield chunk(pa.Table.from_batches(held))


def packed(docs: DataFrame, name: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents as compressed chunks in a table of the shared folder."""
    return staged(documents(docs).mapInArrow(tidy(lambda batches: _pack_batches(batches, chunk_bytes)), CHUNK), name)


def buckets_for(table: DataFrame) -> int:
    """Buckets in proportion to the text, at least one for each shuffle partition."""
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, shuffle_partitions(table.sparkSession), -(-total // BUCKET_BYTES))


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Chunks as arrays; columns of replies become dictionaries from bucket to bytes."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch.column(name)[r] for name in batch.schema.names}
            sizes = np.frombuffer(row["sizes"].as_py(), np.int64)
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["payload"].as_py(), max_output_size=max(1, row["n_bytes"].as_py())), np.uint8)
            ids = np.frombuffer(row["ids"].as_py(), np.int64)
            nulls = np.unpackbits(np.frombuffer(row["nulls"].as_py(), np.uint8), count=len(ids)).astype(bool)
            out = {"chunk": row["chunk"].as_py(), "raw": raw, "offsets": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), "ids": ids, "id_list": [None if n else i for i, n in zip(ids.tolist(), nulls.tolist(), strict=True)]}
            for name, value in row.items():
                if name not in _CHUNK.names:
                    out[name] = {x["bucket"]: x["data"] for x in value.as_py() or ()}
            yield out


MESSAGE = "chunk string, bucket int, data binary"
_MESSAGE = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())])


def ask(table: DataFrame, request: Callable[[dict, int], Iterator[tuple[int, bytes]]], buckets: int) -> DataFrame:
    """Messages ``(chunk, bucket, data)`` of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in unpack(batches):
            rows = list(request(chunk, buckets))
            if rows:
                yield pa.RecordBatch.from_pydict({"chunk": [chunk["chunk"]] * len(rows), "bucket": [b for b, _ in rows], "data": [d for _, d in rows]}, _MESSAGE)

    return table.mapInArrow(tidy(run), MESSAGE)


def replies(messages: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``(chunk, bucket, data)``: the bucket's answers to its messages."""

    def run(table: pa.Table) -> pa.Table:
        out = answer(table.column("data").to_pylist())
        give_back()
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "data": pa.array(out, pa.binary())}, _MESSAGE)

    return messages.groupBy("bucket").applyInArrow(run, MESSAGE)


def attached(table: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """The chunks with their replies, at most one for each bucket, as an array column."""
    lists = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias(name))
    return table.join(lists, "chunk", "left")


def answered(table: DataFrame, messages: DataFrame, answer: Callable[[list[bytes]], list[bytes]], name: str) -> DataFrame:
    """The chunks with the answers to their messages; the replies are written once."""
    return attached(table, staged(replies(messages, answer), name), name)
