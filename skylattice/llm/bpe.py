"""Byte-level BPE encoding and decoding, by recursive queries of an embedded DuckDB in each task.

Encoding: the texts of a slice are cut into the pieces of the pattern and each distinct piece goes
once to DuckDB as rows ``(word, pos, tok)``, one for each byte.  A recursive query joins neighbouring
tokens with the merge table (all pairs of tokens whose bytes make a token, with its rank) and
contracts each word's leftmost pair of least rank until no pair is left.  In long words other pairs of
that rank go in the same round, but only where no token that holds the new one at an end has a smaller
rank, so the order of merges is that of one contraction at a time.  A piece that is a token itself is
that token.

Decoding: rows ``(doc, block, pos, tok)`` join the vocabulary and an aggregate ordered by position
joins the bytes.

A worker keeps bounded tables: the database holds the vocabulary and one slice, and the pieces known
so far are forgotten when there are too many.  A round's rows stay until its query ends, so a query
runs a bounded number of rounds and long words go on in the next one.  Nothing is written to disk.

A null text is the empty text and has no tokens.  Repeated rows are encoded each, null ids are carried
along, other columns are not read, an empty table gives no rows.  Pieces can't tie: at equal rank the
leftmost goes first.  Very long texts are whole slices of their own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .pieces import Lists, Numbered, piece_starts, text_slices

#: Text bytes of a slice, pieces that a worker remembers, bytes from which a word is long, and rows that the
#: rounds of one recursion may hold together.
SLICE_BYTES, KNOWN_PIECES, LONG_WORD, HELD_ROWS = 1 << 20, 600_000, 64, 500_000
#: Tokens of a block of decoding.
BLOCK = 1 << 12
#: Memory of a worker's database.
MEMORY = "400MB"

# A round for short words: the leftmost pair of least rank, one in each word.  Places stay dense.
_CONTRACT = """
WITH RECURSIVE step(word, place, tok, live) AS (
    SELECT word, pos, tok, true FROM start
  UNION ALL
    SELECT s.word, CASE WHEN s.place > b.place THEN s.place - 1 ELSE s.place END, CASE WHEN s.place = b.place THEN b.rank ELSE s.tok END, b.word IS NOT NULL
    FROM step s LEFT JOIN (
        SELECT word, (min(best) >> 32)::INTEGER AS rank, (min(best) & 4294967295)::INTEGER AS place FROM (
            SELECT x.word, (m.rank::BIGINT << 32) | x.place AS best
            FROM step x JOIN step y ON y.word = x.word AND y.place = x.place + 1 JOIN merges m ON m.l = x.tok AND m.r = y.tok
            WHERE x.live AND y.live) GROUP BY word) b ON b.word = s.word
    WHERE s.live AND s.place IS DISTINCT FROM b.place + 1
)
SELECT word, place AS pos, tok, false AS live FROM step WHERE NOT live ORDER BY word, pos
"""

# A round for long words, with other pairs of the least rank where they may go along; {rounds} bounds the recursion.
_CONTRACT_LONG = """
WITH RECURSIVE step(word, pos, tok, round, live) AS (
    SELECT word, pos, tok, 0, true FROM start
  UNION ALL
    SELECT word, pos, coalesce(merged, tok), round + 1, best IS NOT NULL FROM (
        SELECT *, lag(merged) OVER (PARTITION BY word ORDER BY pos) AS eaten FROM (
            SELECT *, CASE WHEN rank = best AND (place = leftmost OR many AND odd) THEN rank END AS merged FROM (
                SELECT *, min(CASE WHEN rank = best THEN place END) OVER (PARTITION BY word) AS leftmost,
                    (place - max(CASE WHEN rank IS DISTINCT FROM best THEN place END) OVER (PARTITION BY word ORDER BY pos)) % 2 = 1 AS odd FROM (
                    SELECT p.*, m.rank, m.many, min(m.rank) OVER (PARTITION BY word) AS best FROM (
                        SELECT *, row_number() OVER own AS place, lead(tok) OVER own AS next FROM (
                            SELECT word, pos, tok, round FROM step WHERE live AND round < {rounds}
                            UNION ALL SELECT DISTINCT word, -1, -1, round FROM step WHERE live AND round < {rounds})
                        WINDOW own AS (PARTITION BY word ORDER BY pos)) p
                    LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next)))
        ) WHERE eaten IS NULL AND pos >= 0
)
SELECT word, pos, tok, live FROM step WHERE NOT live OR round = {rounds} ORDER BY word, pos
"""

_DECODE = "SELECT doc, block, string_agg(v.hex, '' ORDER BY pos) AS hex FROM tokens t JOIN vocab v ON v.id = t.tok GROUP BY doc, block ORDER BY doc, block"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """A worker's database with the vocabulary and the merge table of one file of ranks."""

    _made: dict[str, Merges] = {}

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
        self.db.execute("SET enable_progress_bar = false")
        words = list(ranks)
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "data": pa.array(words, pa.binary()), "hex": [w.hex() for w in words]})
        pairs = [(ranks[w[:i]], ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
        left, right, rank = (pa.array(x, pa.int32()) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
        merges = pa.table({"l": left, "r": right, "rank": rank})
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        # many: nothing that starts or ends with the merged token has a smaller rank.
        self.db.execute("""CREATE TABLE merges AS WITH ends AS (SELECT l AS tok, rank FROM merges UNION ALL SELECT r, rank FROM merges),
            least AS (SELECT tok, min(rank) AS next FROM ends GROUP BY tok)
            SELECT m.l, m.r, m.rank, coalesce(next > m.rank, true) AS many FROM merges m LEFT JOIN least ON tok = m.rank""")
        del vocab, merges
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole = ranks
        self.ids = Lists(np.int32)
        self.known = Numbered(self._learn, self._forget, KNOWN_PIECES)

    @classmethod
    def of(cls, path: str) -> Merges:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.ids = Lists(np.int32)

    def _learn(self, words: list[bytes]) -> None:
        """Adds the words' ids, in groups whose rounds hold a bounded number of rows."""
        rows = np.cumsum([min(len(w), LONG_WORD) ** 2 for w in words])
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + HELD_ROWS, "right")))
            self.ids.add(self.contracted(words[at:to]))
            at = to

    def contracted(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        short, long = [], []
        for i, w in enumerate(words):
            token = self.whole.get(w)
            if token is None:
                (short if len(w) <= LONG_WORD else long).append(i)
            else:
                out[i] = np.array([token], np.int32)
        for asked in (short, long):
            size = np.array([len(words[i]) for i in asked], np.int64)
            word = np.repeat(np.array(asked, np.int32), size)
            pos = (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            tok = self.single[np.frombuffer(b"".join([words[i] for i in asked]), np.uint8)]
            while len(word):
                query = _CONTRACT if asked is short else _CONTRACT_LONG.format(rounds=max(1, HELD_ROWS // len(word)))
                found = self._table(query, start=pa.table({"word": word, "pos": pos, "tok": tok}))
                word, pos, tok, live = (found.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("word", "pos", "tok", "live"))
                done = ~live
                bounds = np.flatnonzero(np.diff(word[done], prepend=-1))
                for i, ids in zip(word[done][bounds].tolist(), np.split(tok[done], bounds[1:]) if len(bounds) else [], strict=True):
                    out[i] = ids.astype(np.int32)
                word, pos, tok = word[live], pos[live], tok[live]
        return out

    def _table(self, query: str, **rows: pa.Table) -> pa.Table:
        """The query's rows; the given tables stand under their names while it runs."""
        for name, table in rows.items():
            self.db.register(name, table)
        found = self.db.sql(query).to_arrow_table()
        for name in rows:
            self.db.unregister(name)
        return found

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the bounds of each text in them."""
        mark = piece_starts(raw, offsets)
        starts = np.flatnonzero(mark)
        index = self.known.of(raw, starts, np.append(starts[1:], len(raw)))
        before = np.concatenate([[0], np.cumsum(self.ids.sizes(index))]).astype(np.int64)
        return self.ids.gather(index), before[np.searchsorted(starts, offsets)]

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids; an id that the vocabulary lacks is an error."""
        size = np.array([len(x) for x in lists], np.int64)
        pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        ids = np.concatenate([np.zeros(0, np.uint32), *lists])
        if len(ids) and (ids.max() >= len(self.whole)):
            raise ValueError(f"no token has the id {int(ids.max())}")
        tokens = pa.table({"doc": np.repeat(np.arange(len(lists), dtype=np.int32), size), "block": (pos // BLOCK).astype(np.int32), "pos": pos, "tok": ids.astype(np.int32)})
        found = self._table(_DECODE, tokens=tokens)
        out: list[list[bytes]] = [[] for _ in lists]
        for doc, text in zip(found.column("doc").to_pylist(), found.column("hex").to_pylist(), strict=True):
            out[doc].append(bytes.fromhex(text))
        return [b"".join(parts) for parts in out]


def _encode_batches(path: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.of(path)
        for rows, raw, offsets in text_slices(batches, SLICE_BYTES):
            ids, bounds = merges.encode(raw, offsets)
            data = ids.astype("<u4").tobytes()
            column = pa.array([data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), column], ["doc_id", "ids"])

    return run


def _decode_batches(path: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.of(path)
        for batch in batches:
            lists = [np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()]
            ends = np.cumsum([len(x) for x in lists])
            at, out = 0, []
            while at < len(lists):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES // 4, "right")))
                out += merges.decode(lists[at:to])
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "data"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: token ids of every text as little-endian unsigned 32-bit integers."""
    return documents(docs, id_col, text_col).mapInArrow(_encode_batches(path), "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, data`` of ``tokens(doc_id, ids)``: the bytes that the ids stand for."""
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decode_batches(path), "doc_id long, ids binary, data binary")


def _digest_batches(path: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.of(path)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for rows, raw, offsets in text_slices(batches, SLICE_BYTES):
            ids, bounds = merges.encode(raw, offsets)
            lists = [x.astype("<u4") for x in np.split(ids, bounds[1:-1])]
            decoded = merges.decode(lists)
            columns = [pa.array([len(x) for x in lists], pa.int64()), pa.array([digest(x.tobytes()) for x in lists]), pa.array([digest(x) for x in decoded])]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document: encoded, and its ids decoded again,
    both in one worker, so that only digests leave it."""
    return documents(docs).mapInArrow(_digest_batches(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
