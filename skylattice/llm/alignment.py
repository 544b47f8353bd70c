"""Alignment of two tokenizers' tokens, with link counts over the corpus by external spill counting.

Side A is a byte-level BPE on a space and the text, side B a piece model on the text (it adds the
space itself).  Where tokens of both sides end at the same byte a group ends; all A tokens of a group
are linked to all its B tokens.

Both tokenizers treat what lies between a space after a visible character and the next such space by
itself, so a text is cut there and each distinct unit is tokenised and aligned once for as long as a
worker remembers it (a bounded number).

Counting is that of an external sort.  A chunk of documents gives pair-document records, ordered side
A first, dealt by the radix of the A id into runs that are compressed and stored in the shared folder.
The heads of the runs (pair, number of documents) are merged by a heap, streams that hold one block of
each run: first some chunks' runs, then all of a radix.  There each pair has its count, and when the
pairs of an A id end its largest count is known.  The counted heads stream back along the stored runs;
contributions are added by document.  The number of radices is fixed: a counted run holds pairs of two
vocabularies and grows with those that occur, not with the text; runs of one radix are dealt over as
many salts as keep a group bounded, and a pair in every document is one entry from each chunk.

Texts that are null, empty, or whose joined tokens differ from the space and the text have no tokens:
zeros and the empty string.  Repeated rows are documents each, null ids are carried along, other columns
are not read, ties for the best are all best, an empty table gives no rows.  Very long texts are chunks
of their own; a group of many tokens is counted by distinct ids, never listed pair by pair.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import os
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions, staged
from .pieces import SPACE, Lists, Numbered, byte_classes, spread, text_slices

#: Text bytes of a slice and of a chunk, units that a worker remembers, and radices of the A id.
SLICE_BYTES, CHUNK_BYTES, KNOWN_UNITS, RADICES = 1 << 20, 8 << 20, 400_000, 64
#: Entries of a run that a stream reads at once, and runs that meet in a group of the first merge at most.
READ_ENTRIES, RUNS_TOGETHER = 4096, 64
#: Links of a group up to which they are listed one by one.
LISTED_LINKS = 4096
#: Bits of an A id, of a B id and of a document's number in its chunk (A and B ids are 31 bits together).
A_BITS, B_BITS, DOC_BITS = 16, 15, 24
_RADIX_BITS = RADICES.bit_length() - 1


def radix_first(a: np.ndarray) -> np.ndarray:
    """A ids with the radix (their low bits) moved to the top."""
    return (a & (RADICES - 1)) << (A_BITS - _RADIX_BITS) | a >> _RADIX_BITS


# ---------------------------------------------------------------- tokens and groups of units


class Aligner:
    """A worker's two tokenizers and the units known so far."""

    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(size)]
        if self.a.get_vocab_size() > 1 << A_BITS or size > 1 << B_BITS:
            raise ValueError("the vocabularies are too large for the packed pairs")
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece of side B spans words")
        letters = {letter: i for i, letter in enumerate(_byte_letters())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for name, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[x] for x in name) if all(x in letters for x in name) else name.encode()
        self.b_bytes = [bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.known = Numbered(self._learn, self._forget, KNOWN_UNITS)
        self._forget()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]

    def _forget(self) -> None:
        self.pairs, self.times = Lists(np.int64), Lists(np.int64)
        #: n_a, n_b, n_groups, n_links and whether the bytes are the unit's, by unit.
        self.numbers = np.zeros((0, 5), np.int64)
        self.groups: list[str] = []

    def _learn(self, units: list[bytes]) -> None:
        """Tokens, groups and links of new units, all of them at once.

        Ends of tokens are places in the joined units, so one intersection finds all common ends.
        """
        texts = [u.decode() for u in units]
        a_lists = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b_lists = [[self.space] if t == " " else ids for t, ids in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]
        good = [b"".join([self.a_bytes[i] for i in a]) == u and b"".join([self.b_bytes[i] for i in b]) == u for u, a, b in zip(units, a_lists, b_lists, strict=True)]
        n_a, n_b = (np.array([len(x) if ok else 0 for x, ok in zip(lists, good, strict=True)], np.int64) for lists in (a_lists, b_lists))
        a, b = (np.array([i for x, ok in zip(lists, good, strict=True) if ok for i in x], np.int64) for lists in (a_lists, b_lists))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        size_a, size_b = np.bincount(in_a, minlength=len(ends)), np.bincount(in_b, minlength=len(ends))
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        unit = np.repeat(np.arange(len(units)), n_a)[first_a] if len(ends) else np.zeros(0, np.int64)
        count = lambda w: np.bincount(unit, w, len(units)).astype(np.int64)
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, count(None), count(size_a * size_b), np.array(good, np.int64)], axis=1)])
        # Links: all pairs of a group; of a large group the pairs of distinct ids with their numbers.
        large = size_a * size_b > LISTED_LINKS
        small = np.flatnonzero(~large)
        x = spread(first_a[small], size_a[small])
        wide = np.repeat(size_b[small], size_a[small])
        pair = np.repeat(a[x], wide) << B_BITS | b[spread(np.repeat(first_b[small], size_a[small]), wide)]
        owner, times = np.repeat(unit[small], size_a[small] * size_b[small]), np.ones(len(pair), np.int64)
        for g in np.flatnonzero(large).tolist():
            (i, n), (j, m) = (np.unique(side[f : f + s], return_counts=True) for side, f, s in ((a, first_a[g], size_a[g]), (b, first_b[g], size_b[g])))
            pair = np.concatenate([pair, (i[:, None] << B_BITS | j[None, :]).ravel()])
            times = np.concatenate([times, (n[:, None] * m[None, :]).ravel()])
            owner = np.concatenate([owner, np.full(len(i) * len(j), unit[g])])
        order = np.argsort(owner, kind="stable")
        cut = np.cumsum(np.bincount(owner, minlength=len(units)))[:-1]
        self.pairs.add(np.split(pair[order], cut))
        self.times.add(np.split(times[order], cut))
        # Text of the groups: side A's ids, then side B's.
        words = np.full(len(a) + len(b), "", object)
        at_a, at_b = np.arange(len(a)) + first_b[in_a], np.arange(len(b)) + (first_a + size_a)[in_b]
        last_a, last_b = np.diff(in_a, append=-1) != 0, np.diff(in_b, append=-1) != 0
        words[at_a] = [f"{i}|" if last else f"{i}," for i, last in zip(a.tolist(), last_a.tolist(), strict=True)]
        words[at_b] = [f"{i};" if last else f"{i}," for i, last in zip(b.tolist(), last_b.tolist(), strict=True)]
        joined = words.tolist()
        bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        self.groups += ["".join(joined[i:j])[:-1] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def documents(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts of a slice: n_a, n_b, n_groups, n_links; digests of the groups; and the linked pairs as
        arrays of document, pair and times (pairs may repeat in a document)."""
        n = len(offsets) - 1
        spaced = np.insert(raw, offsets[:-1], 0x20)
        bounds = offsets + np.arange(n + 1)
        # A unit starts at a space after a visible character, or with the text.
        kind = byte_classes(spaced)
        start = spaced == 0x20
        start[1:] &= kind[:-1] != SPACE
        start[bounds[:-1]] = True
        starts = np.flatnonzero(start)
        unit = self.known.of(spaced, starts, np.append(starts[1:], len(spaced)))
        at = np.searchsorted(starts, bounds)
        sums = np.add.reduceat(self.numbers[unit], at[:-1], axis=0)
        good = (sums[:, 4] == np.diff(at)) & (np.diff(offsets) > 0)
        sums = np.where(good[:, None], sums, 0)
        digests = [hashlib.sha256(";".join([self.groups[u] for u in unit[i:j].tolist()]).encode()).hexdigest() if ok else "" for i, j, ok in zip(at[:-1].tolist(), at[1:].tolist(), good.tolist(), strict=True)]
        doc = np.repeat(np.arange(n), np.diff(at))
        doc, unit = doc[good[doc]], unit[good[doc]]
        size = self.pairs.sizes(unit)
        index = spread(self.pairs.starts[unit], size)
        return sums[:, :4], digests, np.repeat(doc, size), self.pairs.flat[index], self.times.flat[index]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


# ---------------------------------------------------------------- runs


def narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest one needs, compressed; the first byte is their width."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(values.astype(f"<u{width}").tobytes())


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def packed_run(*columns: np.ndarray) -> bytes:
    """Rows of unsigned 64-bit numbers, the first column by differences, compressed."""
    rows = np.stack([c.astype(np.uint64) for c in columns], axis=1) if len(columns[0]) else np.zeros((0, len(columns)), np.uint64)
    if len(rows):
        rows[1:, 0] = np.diff(rows[:, 0])
    return zstandard.ZstdCompressor(level=3).compress(rows.tobytes())


def run_blocks(data: bytes, columns: int, entries: int = READ_ENTRIES) -> Iterator[np.ndarray]:
    """The rows of a run, so many at a time."""
    last = np.uint64(0)
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data))
    while block := reader.read(8 * columns * entries):
        rows = np.frombuffer(block, np.uint64).reshape(-1, columns).copy()
        rows[:, 0] = np.cumsum(rows[:, 0]) + last
        last = rows[-1, 0]
        yield rows


def whole_run(data: bytes, columns: int) -> np.ndarray:
    blocks = list(run_blocks(data, columns, 1 << 16))
    return np.concatenate(blocks) if blocks else np.zeros((0, columns), np.uint64)


def _entries(data: bytes) -> Iterator[tuple[int, int]]:
    for rows in run_blocks(data, 2):
        yield from map(tuple, rows.tolist())


def merged(runs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs in order with the sums of their counts, from a heap over the runs' streams."""
    last, total = -1, 0
    for pair, count in heapq.merge(*map(_entries, runs)):
        if pair != last:
            if last >= 0:
                yield last, total
            last, total = pair, 0
        total += count
    if last >= 0:
        yield last, total


_RUN = pa.schema([("chunk", pa.string()), ("radix", pa.int32()), ("heads", pa.binary()), ("body", pa.binary()), ("times", pa.binary()), ("docs", pa.binary())])
RUN = "chunk string, radix int, heads binary, body binary, times binary, docs binary"
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def _table_bytes(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _bytes_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(data)).read_all()


class _Chunk:
    """Documents and pair-document records gathered for one chunk."""

    def __init__(self) -> None:
        self.docs: list[pa.RecordBatch] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.n_docs = self.n_bytes = 0

    def add(self, ids: pa.Array, n_bytes: int, numbers: np.ndarray, digests: list[str], doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        key = (radix_first(pair >> B_BITS) << B_BITS | pair & ((1 << B_BITS) - 1)) << DOC_BITS | (doc + self.n_docs)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.keys.append(key[first])
        self.times.append(np.add.reduceat(times[order], first) if len(first) else times[:0])
        self.docs.append(pa.RecordBatch.from_arrays([ids, *[pa.array(numbers[:, c]) for c in range(4)], pa.array(digests)], schema=_DOCS))
        self.n_docs += len(digests)
        self.n_bytes += n_bytes

    def rows(self) -> pa.RecordBatch:
        name = uuid.uuid4().hex
        key, times = np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.times])
        order = np.argsort(key)
        key, times = key[order], times[order]
        radix = key >> (A_BITS + B_BITS - _RADIX_BITS + DOC_BITS)
        cut = np.searchsorted(radix, np.arange(RADICES + 1))
        out = [{"chunk": name, "radix": -1, "docs": _table_bytes(pa.Table.from_batches(self.docs, _DOCS))}]
        for r in np.flatnonzero(np.diff(cut)).tolist():
            own, n = key[cut[r] : cut[r + 1]], times[cut[r] : cut[r + 1]]
            pair, doc = own >> DOC_BITS, own & ((1 << DOC_BITS) - 1)
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            heads = packed_run(pair[first], np.diff(first, append=len(pair)))
            # Documents rise within a pair: differences, the first of a pair from zero.
            step = np.diff(doc, prepend=0)
            step[first] = doc[first]
            out.append({"chunk": name, "radix": r, "heads": heads, "body": narrow(step), "times": narrow(n)})
        return pa.RecordBatch.from_pylist(out, _RUN)


def _run_batches(a_path: str, b_path: str, chunk_bytes: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, chunk = Aligner.of(a_path, b_path), _Chunk()
        for rows, raw, offsets in text_slices(batches, SLICE_BYTES):
            if chunk.n_docs and (chunk.n_bytes + len(raw) > chunk_bytes or chunk.n_docs + len(rows) > 1 << DOC_BITS):
                yield chunk.rows()
                chunk = _Chunk()
            chunk.add(rows.column("doc_id"), len(raw), *aligner.documents(raw, offsets))
        if chunk.n_docs:
            yield chunk.rows()

    return run


def _merge_batches(table: pa.Table) -> pa.Table:
    """The heads of a group's runs as one run."""
    rows = np.array(list(merged(table.column("heads").to_pylist())), np.uint64).reshape(-1, 2)
    return pa.table({"radix": table.column("radix").slice(0, 1), "heads": pa.array([packed_run(rows[:, 0], rows[:, 1])], pa.binary())})


def _count_batches(table: pa.Table) -> pa.Table:
    """A radix's pairs with counts, and whether the count is the largest of the A id."""
    pairs, counts, best = [], [], []
    for _, own in groupby(merged(table.column("heads").to_pylist()), lambda e: e[0] >> B_BITS):
        side = list(own)
        most = max(n for _, n in side)
        for pair, n in side:
            pairs.append(pair)
            counts.append(n)
            best.append(n == most)
    data = packed_run(np.array(pairs, np.uint64), np.array(counts, np.uint64), np.array(best, np.uint64))
    return pa.table({"radix": table.column("radix").slice(0, 1), "counted": pa.array([data], pa.binary())})


def _contribution_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for heads, body, times, counted in zip(*(batch.column(c).to_pylist() for c in ("heads", "body", "times", "counted")), strict=True):
            head, known = whole_run(heads, 2), whole_run(counted, 3).astype(np.int64)
            size = head[:, 1].astype(np.int64)
            step, times = widened(body), widened(times)
            before = np.cumsum(step) - step
            doc = np.cumsum(step) - np.repeat(before[np.cumsum(size) - size], size)
            at = np.repeat(np.searchsorted(known[:, 0], head[:, 0].astype(np.int64)), size)
            own, back = np.unique(doc, return_inverse=True)
            count, best = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            np.add.at(count, back, times * known[at, 1])
            np.add.at(best, back, times * known[at, 2])
            out.append(packed_run(own, best, count))
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], ["chunk", "part"])


def _result_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, parts in zip(batch.column("docs").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            table = _bytes_table(docs)
            total = np.zeros((table.num_rows, 2), np.int64)
            for part in parts or ():
                rows = whole_run(part, 3).astype(np.int64)
                total[rows[:, 0]] += rows[:, 1:]
            table = table.add_column(5, "n_best", pa.array(total[:, 0])).add_column(6, "count_sum", pa.array(total[:, 1]))
            yield from table.combine_chunks().to_batches()


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def stored_runs(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The runs of all chunks, and each chunk's documents under radix -1, in the shared folder."""
    return staged(documents(docs).mapInArrow(_run_batches(a_path, b_path, chunk_bytes), RUN), "alignment-runs")


def counted_runs(runs: DataFrame) -> DataFrame:
    """``radix, counted``: pairs of each radix with their counts and marks of the best."""
    heads = runs.where("radix >= 0").select("radix", "heads", (F.pmod(F.xxhash64("chunk"), F.lit(_salts(runs)))).alias("salt"))
    some = heads.groupBy("radix", "salt").applyInArrow(_merge_batches, "radix int, heads binary")
    return staged(some.groupBy("radix").applyInArrow(_count_batches, "radix int, counted binary"), "alignment-counts")


def _salts(runs: DataFrame) -> int:
    """Salts that keep a group to a bounded number of runs and give every shuffle partition a group."""
    chunks = runs.where("radix < 0").count()
    return max(1, -(-chunks // RUNS_TOGETHER), -(-shuffle_partitions(runs.sparkSession) // RADICES))


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row of ``RESULT`` for each document."""
    runs = stored_runs(docs, a_path, b_path, chunk_bytes)
    salts = _salts(runs)
    counts = counted_runs(runs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    own = runs.where("radix >= 0").select("chunk", "radix", "heads", "body", "times", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("long").alias("salt"))
    # Both sides are dealt by radix and salt at every size: counted runs are not broadcast.
    parts = own.join(counts.hint("shuffle_merge"), ["radix", "salt"]).select("chunk", "heads", "body", "times", "counted").mapInArrow(_contribution_batches, "chunk string, part binary")
    lists = parts.groupBy("chunk").agg(F.collect_list("part").alias("parts"))
    return runs.where("radix < 0").select("chunk", "docs").join(lists, "chunk", "left").select("docs", "parts").mapInArrow(_result_batches, RESULT)
