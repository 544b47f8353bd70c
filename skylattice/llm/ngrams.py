"""Language-model scores by an interpolated modified Kneser-Ney bigram model.

Counting and lookup run as messages between chunks of documents and hash buckets (see ``chunks``):

1. Chunks send their distinct bigrams, with the counts in training documents, to the bucket of the
   first word; those of a word with many followers are split over buckets by the following word.  A
   bucket adds the counts up, stores the model's shard as sorted hash arrays, and looks up each chunk's
   bigrams in the memory-mapped arrays: counts, and for each first word its total and its numbers of
   followers seen once, twice and more often.
2. The bucket also sends, for each following word, in how many distinct contexts it stands and how
   often, to that word's bucket, which stores its shard and answers the chunks' distinct words.
3. Chunks put the numbers together: discounted bigram estimate, interpolated with the discounted
   continuation estimate, interpolated with a uniform share for words never seen.

``learn_and_score`` keeps the shards in the shared folder: its ``Model`` scores other texts by messages to
the same buckets, where workers map the stored arrays again.  ``score`` leaves out the bigrams' shards,
whose room would exceed the limit that the query has.

Tokens are lower-cased words and one end for each document; the first token follows a start mark.
Null texts are empty (one end token).  A null id is held out.  With no training documents every
probability is 1.  Repeated rows count as often as they occur; there are no ties to break.  A very
long text is a chunk of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import attached, ask, buckets_for, packed, unpack
from .common import LOWER, SPACE, hash_words, mix, staged, word_spans

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
MODULUS, HELD_OUT = 10, 0
#: Text bytes of a chunk: the larger, the fewer distinct bigrams are sent in all.
CHUNK_BYTES = 9 << 20
#: Chunks read to find the words with many followers, the least number of followers there, and such words
#: at most.  They only decide where bigrams meet, not what is counted.
HOT_CHUNKS, HOT_FOLLOWERS, MAX_HOT = 8, 200, 100_000


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % MODULUS == HELD_OUT


class Tokens:
    """Tokens of a chunk: distinct words, distinct bigrams and where they stand."""

    def __init__(self, chunk: dict) -> None:
        raw, offsets = chunk["raw"], chunk["offsets"]
        low = LOWER[raw]
        starts, ends = word_spans(~SPACE[raw], offsets)
        n_words = np.diff(np.searchsorted(starts, offsets))
        n_docs = len(n_words)
        self.n_tokens = n_words + 1
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        token = np.full(int(self.n_tokens.sum()), END)
        token[np.arange(len(starts)) + np.repeat(np.arange(n_docs), n_words)] = hash_words(low, starts, ends)
        self.words, inverse = np.unique(np.append(token, START), return_inverse=True)
        self.word, start = inverse[:-1], int(inverse[-1])
        before = np.concatenate([[start], self.word[:-1]]) if len(token) else np.zeros(0, np.int64)
        before[self.first] = start
        code, self.bigram = np.unique(before * len(self.words) + self.word, return_inverse=True)
        self.u, self.v = code // len(self.words), code % len(self.words)
        self.training = np.array([not held_out(i) for i in chunk["id_list"]], bool)
        taught = np.repeat(self.training, self.n_tokens)
        self.count = np.bincount(self.bigram[taught], minlength=len(code)).astype(np.uint32)

    def by_bucket(self, words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Stable order by bucket of the words at the given places, and the buckets' bounds."""
        return _ordered(_bucket(self.words, buckets)[words], buckets)

    def pairs_by_bucket(self, buckets: int, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
        """The same for the bigrams: by the first word, and by the second too where the first is hot."""
        place = hot.find(self.words)
        bucket = _bucket(self.words, buckets)[self.u]
        rows = np.flatnonzero((place >= 0)[self.u])
        if len(rows):
            u = self.u[rows]
            part = mix(self.words[self.v[rows]]) % hot.split[place[u]].astype(np.uint64)
            with np.errstate(over="ignore"):
                bucket[rows] = _bucket(mix(self.words[u] + part * np.uint64(0x9E3779B97F4A7C15)), buckets)
        return _ordered(bucket, buckets)


def _bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return ((word >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def _ordered(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


class Hot:
    """Sorted words with many followers, and over how many buckets each is split."""

    def __init__(self, words: np.ndarray, split: np.ndarray) -> None:
        self.words, self.split = words, split

    def find(self, word: np.ndarray) -> np.ndarray:
        """Places in the list, -1 for others."""
        if not len(self.words):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at, -1)


def hot_words(table: DataFrame, buckets: int) -> Hot:
    """Words that hold more than an eighth of a bucket's share of the distinct bigrams of a few chunks."""
    ids = [r["chunk"] for r in table.select("chunk").orderBy(F.xxhash64("chunk")).limit(HOT_CHUNKS).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in unpack(batches):
            t = Tokens(chunk)
            n = np.bincount(t.u, minlength=len(t.words))
            many = np.flatnonzero((n >= HOT_FOLLOWERS) & (n * 8 * buckets >= len(t.u)))
            yield pa.RecordBatch.from_pydict({"word": t.words[many].view(np.int64), "share": n[many] / max(1, len(t.u))}, pa.schema([("word", pa.int64()), ("share", pa.float64())]))

    found = table.where(F.col("chunk").isin(ids)).mapInArrow(run, "word long, share double").groupBy("word").agg((F.sum("share") / HOT_CHUNKS).alias("share"))
    rows = found.orderBy(F.desc("share"), "word").limit(MAX_HOT).collect()
    words = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    split = np.array([min(buckets, max(2, int(np.ceil(4 * r["share"] * buckets)))) for r in rows], np.int64)
    order = np.argsort(words)
    return Hot(words[order], split[order])


def _planes(array: np.ndarray) -> bytes:
    """The array byte by byte, sorted 64-bit hashes as differences: planes of zeros take no room when compressed."""
    if array.dtype == np.uint64:
        array = np.diff(array, prepend=np.uint64(0))
    return np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T.tobytes() if len(array) else b""


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    array = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(array, dtype=np.uint64) if kind is np.uint64 else array


def _wrap(*arrays: np.ndarray) -> bytes:
    """Arrays in one message; unsigned 64-bit ones are sorted."""
    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(_planes, arrays)))


def _unwrap(data: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    at, out = 8 + 8 * n, []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        end = at + size * np.dtype(kind).itemsize
        out.append(_from_planes(data[at:end], kind))
        at = end
    return out


def _bigram_request(hot: Hot) -> object:
    def make(chunk: dict, buckets: int) -> Iterator[tuple[int, bytes]]:
        t = Tokens(chunk)
        order, cut = t.pairs_by_bucket(buckets, hot)
        for b in range(buckets):
            own = order[cut[b] : cut[b + 1]]
            if len(own):
                u, run = np.unique(t.u[own], return_counts=True)
                v, place = np.unique(t.v[own], return_inverse=True)
                small = np.uint16 if len(v) < 1 << 16 else np.uint32
                yield b, bytes([np.dtype(small).itemsize]) + _wrap(t.words[u], run.astype(np.uint32), t.words[v], place.astype(small), t.count[own])

    return make


def _asked(data: bytes) -> list[np.ndarray]:
    return _unwrap(data[1:], np.uint64, np.uint32, np.uint64, np.uint16 if data[0] == 2 else np.uint32, np.uint32)


def _word_request(chunk: dict, buckets: int) -> Iterator[tuple[int, bytes]]:
    t = Tokens(chunk)
    order, cut = t.by_bucket(np.arange(len(t.words)), buckets)
    for b in range(buckets):
        own = order[cut[b] : cut[b + 1]]
        if len(own):
            yield b, _wrap(t.words[own])


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (u ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + v
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


class Shard:
    """Sorted hash arrays in a memory-mapped scratch file that goes with the task."""

    def __init__(self, key: np.ndarray, *columns: np.ndarray) -> None:
        self.file = tempfile.TemporaryFile()
        self.key = self._mapped(key)
        self.columns = [self._mapped(c) for c in columns]

    def _mapped(self, array: np.ndarray) -> np.ndarray:
        if not len(array):
            return array
        at = self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(array).data)
        self.file.flush()
        return np.memmap(self.file, array.dtype, "r", at, array.shape)

    def find(self, key: np.ndarray) -> list[np.ndarray]:
        """The columns at the keys, zero where a key is missing."""
        if not len(self.key):
            return [np.zeros(len(key), c.dtype) for c in self.columns]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = self.key[at] == key
        return [np.where(there, c[at], 0).astype(c.dtype) for c in self.columns]


def _counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.array([(c == k).sum() for k in (1, 2, 3, 4)], np.int64)


def _as_text(numbers: np.ndarray) -> bytes:
    return ",".join(map(str, numbers.tolist())).encode()


_KINDS = "kind string, chunk string, bucket int, data binary"
_KINDS_ARROW = pa.schema([("kind", pa.string()), ("chunk", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(_KINDS_ARROW.names)}, _KINDS_ARROW)


def _answer_bigrams(asked: list[np.ndarray], grams: Shard, contexts: Shard) -> bytes:
    u, run, v, place, _ = asked
    return _wrap(*grams.find(pair_hash(np.repeat(u, run), v[place])), *contexts.find(u))


def _bigram_bucket(buckets: int, hot: Hot, keep: bool) -> object:
    def run(table: pa.Table) -> pa.Table:
        asked = [_asked(data) for data in table.column("data").to_pylist()]
        u = np.concatenate([np.repeat(m[0], m[1]) for m in asked])
        v = np.concatenate([m[2][m[3]] for m in asked])
        c = np.concatenate([m[4] for m in asked]).astype(np.int64)
        taught = c > 0
        u, v, c = u[taught], v[taught], c[taught]
        key, first, inverse = np.unique(pair_hash(u, v), return_index=True, return_inverse=True)
        total = np.bincount(inverse, c, len(key)).astype(np.int64)
        of_u, of_v = u[first], v[first]
        context, place = np.unique(of_u, return_inverse=True)
        sums = [np.bincount(place, w, len(context)).astype(np.int64) for w in (total, total == 1, total == 2, total > 2)]
        grams, contexts = Shard(key, total), Shard(context, *sums)
        rows = [("shard", None, table.column("bucket")[0].as_py(), _wrap(key, total, context, *sums))] if keep else []
        for m, chunk, bucket in zip(asked, table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), strict=True):
            rows.append(("grams", chunk, bucket, _answer_bigrams(m, grams, contexts)))
        word, place = np.unique(of_v, return_inverse=True)
        contexts_of = np.bincount(place, minlength=len(word)).astype(np.int64)
        count_of = np.bincount(place, total, len(word)).astype(np.int64)
        order, cut = _ordered(_bucket(word, buckets), buckets)
        for b in range(buckets):
            own = order[cut[b] : cut[b + 1]]
            if len(own):
                rows.append(("cont", None, b, _wrap(word[own], contexts_of[own], count_of[own])))
        # Parts of the hot words' contexts, which are added up over the buckets.
        for k in np.flatnonzero(hot.find(context) >= 0).tolist():
            rows.append(("part", None, -1, _as_text(np.array([context[k].view(np.int64), *[x[k] for x in sums]]))))
        rows.append(("stat", None, -1, _as_text(_counts_of_counts(total))))
        return _rows(rows)

    return run


def _word_bucket(table: pa.Table) -> pa.Table:
    parts, asked = [], []
    for kind, chunk, bucket, data in zip(*[table.column(n).to_pylist() for n in _KINDS_ARROW.names], strict=True):
        if kind == "cont":
            parts.append(_unwrap(data, np.uint64, np.int64, np.int64))
        else:
            asked.append((chunk, bucket, _unwrap(data, np.uint64)[0]))
    word = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    key, place = np.unique(word, return_inverse=True)
    contexts, count = (np.bincount(place, np.concatenate([p[i] for p in parts]), len(key)).astype(np.int64) if parts else np.zeros(0, np.int64) for i in (1, 2))
    shard = Shard(key, contexts, count)
    rows = [("shard", None, table.column("bucket")[0].as_py(), _wrap(key, contexts, count))]
    rows += [("words", chunk, bucket, _wrap(*shard.find(words))) for chunk, bucket, words in asked]
    stat = np.concatenate([_counts_of_counts(contexts), [(contexts > 2).sum(), contexts.sum(), len(key), count.sum()]]).astype(np.int64)
    rows.append(("stat", None, -1, _as_text(stat)))
    return _rows(rows)


def _lookup_bucket(kind: str) -> object:
    """Answers to chunks from a stored shard, which lies among the bucket's rows (none: nothing was learnt there)."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*[table.column(n).to_pylist() for n in _KINDS_ARROW.names], strict=True))
        none = np.zeros(0, np.int64)
        stored = next((data for k, _, _, data in rows if k == "shard"), None)
        if kind == "grams":
            key, total, context, *sums = _unwrap(stored, np.uint64, np.int64, np.uint64, *[np.int64] * 4) if stored else [none.view(np.uint64), none, none.view(np.uint64), *[none] * 4]
            grams, contexts = Shard(key, total), Shard(context, *sums)
            return _rows([(kind, chunk, b, _answer_bigrams(_asked(data), grams, contexts)) for k, chunk, b, data in rows if k == "ask"])
        shard = Shard(*(_unwrap(stored, np.uint64, np.int64, np.int64) if stored else [none.view(np.uint64), none, none]))
        return _rows([(kind, chunk, b, _wrap(*shard.find(_unwrap(data, np.uint64)[0]))) for k, chunk, b, data in rows if k == "ask"])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of one, two and more, from the counts of counts."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(d, 0.05), k) for d, k in zip(raw, (0.95, 1.9, 2.85), strict=True)])


def _discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(count - np.concatenate([[0.0], d])[np.minimum(count, 3)], 0.0)


def _finish(d2: np.ndarray, word_stat: np.ndarray, hot: Hot, hot_sums: np.ndarray) -> object:
    d1 = discounts(word_stat[:4])
    m1, m2 = word_stat[0], word_stat[1]
    m3, contexts_all, n_types, n_train = (int(x) for x in word_stat[4:8])
    spread = float(d1 @ [m1, m2, m3]) / contexts_all if contexts_all else 1.0

    def make(chunk: dict, buckets: int) -> pa.RecordBatch:
        t = Tokens(chunk)
        contexts, count = np.zeros(len(t.words), np.int64), np.zeros(len(t.words), np.int64)
        order, cut = t.by_bucket(np.arange(len(t.words)), buckets)
        for b, data in chunk["words"].items():
            own = order[cut[b] : cut[b + 1]]
            contexts[own], count[own] = _unwrap(data, np.int64, np.int64)
        below = spread / (n_types + 1) + _discounted(contexts, d1) / max(contexts_all, 1)
        seen = np.zeros(len(t.u), np.int64)
        of_u = np.zeros((4, len(t.words)), np.int64)
        order, cut = t.pairs_by_bucket(buckets, hot)
        for b, data in chunk["grams"].items():
            own = order[cut[b] : cut[b + 1]]
            found = _unwrap(data, *[np.int64] * 5)
            seen[own] = found[0]
            of_u[:, np.unique(t.u[own])] = np.stack(found[1:])
        place = hot.find(t.words)
        of_u[:, place >= 0] = hot_sums[:, place[place >= 0]]
        total = of_u[0][t.u]
        safe = np.maximum(total, 1)
        weight = (d2 @ of_u[1:])[t.u] / safe
        p = np.where(total > 0, _discounted(seen, d2) / safe + weight * below[t.v], below[t.v])
        logs = np.log10(p)[t.bigram]
        base = np.log10((count + 0.1) / (n_train + 0.1 * (n_types + 1)))[t.word]
        known = (count > 0)[t.word]
        n = len(t.n_tokens)
        at = t.first
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": chunk["id_list"],
                "held_out": (~t.training).tolist(),
                "n_tokens": t.n_tokens.astype(np.int64),
                "n_known": np.add.reduceat(known.astype(np.int64), at) if n else [],
                "train_tokens": np.full(n, n_train, np.int64),
                "base_score": np.add.reduceat(base, at) if n else [],
                "score": np.add.reduceat(logs, at) if n else [],
            },
            pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]),
        )

    return make


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Model:
    """Stored shards of bigrams and words (tables of the shared folder), and the numbers that all chunks need."""

    grams: DataFrame
    words: DataFrame
    buckets: int
    hot: Hot
    make: Callable[[dict, int], pa.RecordBatch]

    def score(self, docs: DataFrame) -> DataFrame:
        """Scores of any documents; what they hold changes nothing in the model."""
        table = packed(docs, "ngram-chunks", CHUNK_BYTES)

        def answers(request: Callable, shards: DataFrame, kind: str) -> DataFrame:
            asked = ask(table, request, self.buckets).select(F.lit("ask").alias("kind"), "chunk", "bucket", "data")
            return staged(asked.unionAll(shards.where("kind = 'shard'")).groupBy("bucket").applyInArrow(_lookup_bucket(kind), _KINDS), kind)

        return _put_together(table, answers(_bigram_request(self.hot), self.grams, "grams"), answers(_word_request, self.words, "words"), self)


def _put_together(table: DataFrame, grams: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    both = attached(attached(table, grams.where("kind = 'grams'"), "grams"), words.where("kind = 'words'"), "words")
    make, buckets = model.make, model.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in unpack(batches):
            yield make(chunk, buckets)

    return both.mapInArrow(run, OUT).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def learn_and_score(docs: DataFrame, keep: bool = True) -> tuple[Model, DataFrame]:
    """The model of the training documents, and the scores of all documents, from one exchange.

    Without ``keep`` the bigrams' shards are not stored, and the model is for these documents only.
    """
    table = packed(docs, "ngram-chunks", CHUNK_BYTES)
    buckets = buckets_for(table)
    hot = hot_words(table, buckets)
    messages = ask(table, _bigram_request(hot), buckets)
    grams = staged(messages.groupBy("bucket").applyInArrow(_bigram_bucket(buckets, hot, keep), _KINDS), "bigrams")
    asked = ask(table, _word_request, buckets).select(F.lit("ask").alias("kind"), "chunk", "bucket", "data")
    words = staged(asked.unionAll(grams.where("kind = 'cont'")).groupBy("bucket").applyInArrow(_word_bucket, _KINDS), "words")
    numbers = lambda rows, kind: rows.where(F.col("kind") == kind).select(F.split(F.col("data").cast("string"), ",").alias("s"))
    total = lambda n, first=0: [F.sum(F.col("s")[i].cast("long")).alias(f"n{i}") for i in range(first, n)]

    def stats(rows: DataFrame, n: int) -> np.ndarray:
        # One row of n numbers from each bucket is added up on the executors.
        return np.array([x or 0 for x in numbers(rows, "stat").agg(*total(n)).first()], np.int64)

    hot_sums = np.zeros((4, len(hot.words)), np.int64)
    # At most one row for each hot word comes back.
    for row in numbers(grams, "part").groupBy(F.col("s")[0].cast("long").alias("word")).agg(*total(5, 1)).collect():
        at = hot.find(np.array([row["word"]], np.int64).view(np.uint64))[0]
        hot_sums[:, at] = [row[f"n{i}"] for i in range(1, 5)]
    model = Model(grams, words, buckets, hot, _finish(discounts(stats(grams, 4)), stats(words, 8), hot, hot_sums))
    return model, _put_together(table, grams, words, model)


def score(docs: DataFrame) -> DataFrame:
    """Scores of all documents, and their perplexity for each token (see the module's docstring)."""
    return learn_and_score(docs, keep=False)[1]
