"""Near duplicates by SimHash fingerprints, found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  If two fingerprints differ in at
most two bits, one segment holds none of the differences (pigeonhole) and every other segment holds
at most two.  The perfect binary Golay code of length 23 turns a segment into the indices of the
codewords near it: two segments that differ in at most two bits have a common neighbour at distance
one of each, which decodes to one codeword, so they share an index.  A key is an untouched segment
with one index of the next segment; fingerprints that share a key are candidates and are verified.

A null or blank text has the fingerprint zero, which links like any other.  Repeated rows and exact
copies share a fingerprint and so a component.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import shingles
from ..operators.graph import connected_components
from .common import LOWER_BYTES, documents, staged, tidy, without

#: Segments of the fingerprint: first bit and number of bits.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the binary Golay code (fixed value).
GENERATOR = 0xAE3
#: Buckets of more fingerprints than this are linked through shared neighbours in place of pairs.
PAIRED_BUCKET = 32
#: Differing bits at most; the Golay keys are proven for this number.
MAX_BITS = 2


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of lower-cased UTF-8 text; zero without words."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: n - 1].tolist()]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(n, 64)
    set_bits = 2 * bits.sum(axis=0, dtype=np.int64) > n
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        marks = np.array([fingerprint(t.encode()) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``: fp is the fingerprint's bits as a signed long."""
    return documents(docs).mapInArrow(tidy(_fingerprint_batches), "doc_id long, fp long")


def _remainders(first: int, last: int) -> np.ndarray:
    """Syndromes of all words of the bits from first to before last, by linearity from the single bits."""
    table = np.zeros(1, np.uint16)
    for bit in range(first, last):
        word = 1 << bit
        for shift in range(22, 10, -1):
            if word >> shift & 1:
                word ^= GENERATOR << (shift - 11)
        table = np.concatenate([table, table ^ np.uint16(word)])
    return table


class Golay:
    """Nearest codeword of every 23-bit word; the syndrome is that of the low and that of the high bits."""

    _shared: Golay | None = None

    def __init__(self) -> None:
        self.low, self.high = _remainders(0, 12), _remainders(12, 23)
        self.error = np.zeros(2048, np.uint32)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                word = sum(1 << b for b in bits)
                self.error[self.low[word & 4095] ^ self.high[word >> 12]] = word

    @classmethod
    def shared(cls) -> Golay:
        if cls._shared is None:
            cls._shared = cls()
        return cls._shared

    def index(self, words: np.ndarray) -> np.ndarray:
        """Twelve-bit index of the codeword nearest to each word."""
        syndrome = self.low[words & np.uint32(4095)] ^ self.high[words >> np.uint32(12)]
        return (words ^ self.error[syndrome]) >> np.uint32(11)

    def near(self, words: np.ndarray) -> np.ndarray:
        """Indices of the codewords of each word and of its 23 neighbours, shape (n, 24)."""
        flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
        return self.index(words[:, None] ^ flips)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position in fp, key) of all keys of the fingerprints."""
    golay = Golay.shared()
    fp = fp.view(np.uint64)
    segment = [((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.uint32) for at, width in SEGMENTS]
    rows, keys = [], []
    for s in range(3):
        near = np.sort(golay.near(segment[(s + 1) % 3]), axis=1).astype(np.int64)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        row, at = np.nonzero(fresh)
        rows.append(row)
        keys.append((np.int64(s) << np.int64(40)) | (segment[s][row].astype(np.int64) << np.int64(12)) | near[row, at])
    return np.concatenate(rows), np.concatenate(keys)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        row, key = fuzzy_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints of ``fps(fp)`` within two bits.

    Small buckets are verified pair by pair.  In a larger bucket every fingerprint is listed under
    itself and its 64 one-bit neighbours: two fingerprints share such an entry just if they differ
    in two bits or fewer, and each entry, of at most 65 rows, links to its least member.
    """
    keyed = staged(fps.select("fp").mapInArrow(tidy(_key_batches), "key long, fp long"), "simhash-keys")
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    small = keyed.join(size.where(F.col("n") <= PAIRED_BUCKET).select("key"), "key")
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    large = keyed.join(size.where(F.col("n") > PAIRED_BUCKET).select("key"), "key").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    entry = large.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("near"))
    starred = entry.select("fp", F.min("fp").over(Window.partitionBy("near")).alias("b")).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(starred).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document (see the module's docstring)."""
    marks = staged(fingerprints(docs), "simhash")
    least = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(links(least))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(docs: DataFrame) -> DataFrame:
    """``x, y``: pairs of ids that connect all documents whose fingerprints are linked."""
    marks = staged(fingerprints(docs).where("doc_id is not null"), "simhash")
    least = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    copies = marks.join(least, "fp").where("doc_id <> first").select(F.col("first").alias("x"), F.col("doc_id").alias("y"))
    side = lambda n, first: least.select(F.col("fp").alias(n), F.col("first").alias(first))
    return copies.union(links(least).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one, the least id, kept of each component; all columns stay.

    Fingerprints and their Golay keys propose pairs, exact shingle similarity verifies them, and
    ``shingles`` completes the components with the similar pairs that two bits miss.  Rows that repeat a
    kept id stay together; a row with a null id always stays.
    """
    found = shingles.near_duplicates(docs, candidates(docs))
    return without(docs, found.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
