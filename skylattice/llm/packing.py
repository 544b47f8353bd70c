"""Best-fit packing of token sequences by a configuration linear program.

Texts are tokenised where they lie; a document is its ids and one separator, cut into pieces of the
capacity.  Spark counts the pieces of each length, at most ``CAPACITY`` numbers.  On that histogram
the driver solves the configuration program (how often to use each combination of lengths) with
multiplicative weights: lengths that are behind in coverage gain weight, a knapsack dynamic program
prices the best combination around every length, and the best of them are used a little.  The
fractional uses are rounded and what is left is solved again, a bounded number of times; best-fit
decreasing packs the few pieces that no round placed in a full sequence.  Spark then numbers the
pieces of each length and gives each its place from the (bounded) plan.

Null and empty texts are one separator.  Repeated rows are packed separately; equal pieces may change
places.  Very long texts are cut into many pieces, held one text at a time.  An empty table gives no
rows.  A text's tokens do not depend on where white space splits it, so parts of words are cached.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions, staged, tidy

CAPACITY = 2048
#: Rounds of multiplicative weights and combinations used in each: bounds the plan's size.
ROUNDS, PER_ROUND = 150, 24
#: Exponent of the weights, and share of the tightest remaining demand that one use takes.
STRENGTH, STEP = 0.5, 0.5
#: Times that what rounding left is solved again, rounds in each, and tokens that a full sequence may lack.
DIVES, DIVE_ROUNDS, SLACK = 12, 30, 1
#: Parts of words and odd words that a Python worker keeps with their ids, pieces ranked together in
#: one window group, and documents whose texts are held at once.
CACHED_PIECES, CACHED_WORDS, RANKED_TOGETHER, HELD_TEXTS = 300_000, 50_000, 50_000, 256
SEPARATOR = b"\0\0\0\0"

# The pre-tokenizer's pieces of lower-cased text (fixed value, after the tokenizer's file), for plain text:
# printable ASCII, white space and the composed Latin letters, which normalising leaves as they are.
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\\x20\\x09-\\x0da-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_ODD = re.compile("[^\\x20-\\x7e\\x09-\\x0d\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<\\|")
_SPACES = re.compile("[\\x20\\x09-\\x0d]+")


class _Known(dict):
    """Strings with their ids; an unknown one is looked up once, and a full table starts anew."""

    def __init__(self, find: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[part] = ids = self.find(part)
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordIds:
    """Token ids of texts as little-endian bytes; parts of words are remembered within a worker."""

    _made: dict[str, WordIds] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.letters = dict(enumerate(_byte_letters()))
        self.pieces = _Known(self._piece, CACHED_PIECES)
        self.known = _Known(self._word, CACHED_WORDS)

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        if _ODD.search(word):
            return _packed(self.full.encode(word, add_special_tokens=False).ids)
        return self._plain(word)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return b"".join(map(self.known.__getitem__, _SPACES.split(text)))
        return self._plain(text)


def _piece_batches(path: str, capacity: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(path)
        size = 4 * capacity
        for batch in (whole.slice(at, HELD_TEXTS) for whole in batches for at in range(0, whole.num_rows, HELD_TEXTS)):
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.encode(text) + SEPARATOR
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    return documents(docs).mapInArrow(tidy(_piece_batches(tokenizer, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def price(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value within each room, and the last length used (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = value[1 : room + 1] + best[room - 1 :: -1][:room]
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-15:
            best[room], last[room] = gain[k], k + 1
        else:
            best[room] = best[room - 1]
            last[room] = last[room - 1] if last[room - 1] else 0
    return best, last


def _filled(last: np.ndarray, room: int, pattern: dict[int, int], available: np.ndarray) -> None:
    """Adds the priced lengths to a pattern, as far as so many of them are left."""
    while room > 0 and last[room]:
        s = int(last[room])
        if pattern.get(s, 0) + 1 > available[s]:
            room -= 1
            continue
        pattern[s] = pattern.get(s, 0) + 1
        room -= s


def configuration(count: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], float]]:
    """A covering solution of the configuration program: fractional uses of combinations of lengths.

    Multiplicative weights: a length's weight falls exponentially with its coverage, the dynamic
    program prices the best combination around each length, and the best ones are used a little.
    What no round covers goes in whole combinations around it at the end.
    """
    sizes = np.flatnonzero(count)
    size = np.arange(capacity + 1)
    covered = np.zeros(capacity + 1)
    use: dict[tuple, float] = {}

    def take(pattern: dict[int, int], share: float) -> None:
        key = tuple(sorted(pattern.items(), reverse=True))
        step = share * min((1 - covered[t]) * count[t] / a for t, a in key)
        if step > 0:
            use[key] = use.get(key, 0.0) + step
            for t, a in key:
                covered[t] += step * a / count[t]

    for n in range(rounds):
        open_sizes = sizes[covered[sizes] < 1 - 1e-6]
        if not len(open_sizes):
            break
        share = STEP if n < rounds - 1 else 1.0
        value = np.full(capacity + 1, -1.0)
        value[open_sizes] = size[open_sizes] / capacity * np.exp(-STRENGTH * covered[open_sizes])
        best, last = price(value, capacity)
        worth = value[open_sizes] + best[capacity - open_sizes]
        # Of the combinations around each length, the best for the weights and the best for the longest lengths.
        chosen = open_sizes[np.argsort(-worth, kind="stable")[: PER_ROUND // 2]]
        behind = open_sizes[np.argsort(covered[open_sizes] - size[open_sizes] / capacity, kind="stable")]
        few = behind[: PER_ROUND // 2] if n < rounds - 1 else behind
        for s in dict.fromkeys([*few.tolist(), *chosen.tolist()]):
            pattern = {s: 1}
            _filled(last, capacity - s, pattern, np.ceil(np.maximum(1 - covered, 0) * count - 1e-9))
            take(pattern, share)
    return list(use.items())


def rounded(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole uses from the program: solved, rounded and solved again for what is left, until little is.

    In each dive the combinations are taken from the greatest fractional use on: rounded down, and
    the largest fractions, while they fill a sequence, rounded up, as long as the lengths last.
    """
    left, packed = count.copy(), []
    for dive in range(DIVES):
        if not left.any():
            break
        solved = sorted(configuration(left, capacity, ROUNDS if dive == 0 else DIVE_ROUNDS), key=lambda e: (-e[1], e[0]))
        whole, slack = 0, SLACK * dive
        for up in (False, True):
            for key, x in solved:
                if sum(t * a for t, a in key) < capacity - slack:
                    continue
                times = min([1 if up else int(x + 1e-9), *(int(left[s]) // a for s, a in key)])
                if times:
                    packed.append((dict(key), times))
                    whole += times
                    for s, a in key:
                        left[s] -= a * times
        if not whole:
            break
    return packed


def best_fit(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: bins of equal contents are handled together."""
    free: dict[int, list[tuple[dict[int, int], int]]] = {capacity: []}
    rooms = np.zeros(capacity + 1, np.int64)
    for s in range(capacity, 0, -1):
        left = int(count[s])
        while left:
            fits = np.flatnonzero(rooms[s:])
            if not len(fits):
                each = capacity // s
                whole, rest = divmod(left, each)
                for bins, a in ((whole, each), (1 if rest else 0, rest)):
                    if bins:
                        free.setdefault(capacity - a * s, []).append(({s: a}, bins))
                        rooms[capacity - a * s] += bins
                break
            room = int(fits[0]) + s
            pattern, bins = free[room].pop()
            used = min(bins, left)
            rooms[room] -= used
            if used < bins:
                free[room].append((pattern, bins - used))
            grown = dict(pattern)
            grown[s] = grown.get(s, 0) + 1
            free.setdefault(room - s, []).append((grown, used))
            rooms[room - s] += used
            left -= used
    return [entry for group in free.values() for entry in group]


def plan(count: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Combinations of lengths and how often to use each, so that all pieces are packed, and the
    number of sequences that come from the program; best-fit decreasing packs what rounding leaves."""
    packed = rounded(count, capacity)
    left = count.copy()
    for pattern, times in packed:
        for s, a in pattern.items():
            left[s] -= a * times
    return packed + best_fit(left, capacity), sum(times for _, times in packed)


PLAN_SCHEMA = "p_length long, lo long, hi long, first_sequence long, each long, at long"


def plan_rows(packed: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> list[tuple]:
    """Ranges of the pieces of each length: where the pieces ranked lo .. hi - 1 go."""
    rows, sequence = [], 0
    taken = np.zeros(capacity + 1, np.int64)
    for pattern, times in packed:
        at = 0
        for s, a in sorted(pattern.items(), reverse=True):
            lo = int(taken[s])
            rows.append((s, lo, lo + a * times, sequence, a, at))
            taken[s] += a * times
            at += a * s
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its offset there (see the module's docstring)."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer, capacity), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most `capacity` rows
        count[row["length"]] = row["count"]
    spread = max(shuffle_partitions(spark), int(count.sum()) // RANKED_TOGETHER)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    start = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(F.col("length").alias("s_length"), F.col("salt").alias("s_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("within", within)
    ranked = ranked.join(start, (F.col("length") == F.col("s_length")) & (F.col("salt") == F.col("s_salt"))).withColumn("rank", F.col("before") + F.col("within") - 1)
    # The plan's rows are bounded by ROUNDS, PER_ROUND and the capacity, whatever the number of pieces.
    places = spark.createDataFrame(plan_rows(plan(count, capacity)[0], capacity), PLAN_SCHEMA)
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + k % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
