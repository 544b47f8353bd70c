"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` writes one row per segment (a block of whole documents): the segment's distinct
terms, sorted by hash, and the positions of each term in the segment.  Documents are a gap apart, so
no match crosses their bounds.  ``search`` takes the benchmark's windows, in blocks of at most
``WINDOW_BLOCK`` of which the driver holds one, to every segment: it looks the terms up, starts from the postings of each window's
rarest term, shifts them by the term's offset and intersects them with the postings of the next
rarest terms until all ten agree.  Nothing is shuffled but the (document, item) hits.

Null or wordless texts have no words, no hits and are clean.  An item without words has no window.
Repeated rows of either table count on their own (an item id is listed once).  Of equally rare terms
the first of a window starts the search, which changes no result.  A very long text is a segment by
itself; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, documents, hash_words, staged, text_buffer, tidy, without, word_spans

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Positions between two documents of a segment.
GAP = 1
#: Text bytes of a segment (a longer document has its own), and windows sent to the segments at once.
SEGMENT_BYTES = 4 << 20
WINDOW_BLOCK = 200_000
#: Starts of windows that are tried at once.
TRIED = 1 << 18
#: A proximity match has this share of a window's terms, each within SLOP words of its place, in one document.
NEAR_SHARE, SLOP = 0.8, 2

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[0x80:] = True

INDEX_SCHEMA = "segment string, doc_ids array<long>, n_words array<int>, terms binary, counts binary, positions binary"


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes in text order, and the number of words of each row."""
    low = LOWER[raw]
    starts, ends = word_spans(_WORD[low], offsets)
    return hash_words(low, starts, ends), np.diff(np.searchsorted(starts, offsets))


def _segment(doc_ids: list, term: np.ndarray, n_words: np.ndarray) -> dict:
    position = np.arange(len(term)) + np.repeat(np.arange(len(n_words)) * GAP, n_words)
    order = np.argsort(term, kind="stable")
    unique, count = np.unique(term, return_counts=True)
    return {"segment": uuid.uuid4().hex, "doc_ids": doc_ids, "n_words": n_words.tolist(), "terms": unique.tobytes(), "counts": count.astype(np.uint32).tobytes(), "positions": position[order].astype(np.uint32).tobytes()}


_ARROW = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, (raw, offsets) = batch.column("doc_id").to_pylist(), text_buffer(batch.column("text"))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT_BYTES, "right")) - 1)
            term, n_words = terms_of(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            yield pa.RecordBatch.from_pylist([_segment(ids[at:to], term, n_words)], _ARROW)
            at = to


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of all documents, written to the shared folder."""
    return staged(documents(docs).mapInArrow(tidy(_index_batches), INDEX_SCHEMA), "postings")


class Windows:
    """A block of benchmark windows as arrays: terms (n, WINDOW) padded with the first term."""

    def __init__(self, item: list, term: np.ndarray, size: np.ndarray) -> None:
        self.item, self.term, self.size = item, term, size


def windows(rows: Iterator[tuple[int, str | None]]) -> Iterator[Windows]:
    """Distinct windows of the items, in blocks of at most WINDOW_BLOCK, however long an item is."""
    item, term, size = [], [], []

    def block() -> Windows:
        table = np.stack(term) if term else np.zeros((0, WINDOW), np.uint64)
        return Windows(list(item), table, np.array(size, np.int64))

    for item_id, text in rows:
        raw, offsets = text_buffer(pa.array([text or ""], pa.large_string()))
        words, _ = terms_of(raw, offsets)
        if item_id is None or not len(words):
            continue
        n = min(WINDOW, len(words))
        seen = set()
        for at in range(len(words) - n + 1):
            window = words[at : at + n]
            if window.tobytes() not in seen:
                seen.add(window.tobytes())
                item.append(item_id)
                size.append(n)
                term.append(np.concatenate([window, np.full(WINDOW - n, window[0], np.uint64)]))
            # A long item goes on in the next block, where a window may come again: its hits are put together.
            if len(item) >= WINDOW_BLOCK:
                yield block()
                item, term, size, seen = [], [], [], set()
    if item:
        yield block()


def lookup(segment: dict, block: Windows, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact occurrences and near ones in a segment: rows (window, position, exact).

    An exact occurrence has its first position, a near one a position of one of its terms.  A match
    of all but m terms holds one of the window's m + 1 rarest terms, so each of these starts a
    search, for matches without the rarer ones; none is missed, whatever the segment's other documents.
    """
    terms = np.frombuffer(segment["terms"], np.uint64)
    count = np.frombuffer(segment["counts"], np.uint32).astype(np.int64)
    posting = np.frombuffer(segment["positions"], np.uint32).astype(np.int64)
    empty = np.zeros(0, np.int64)
    if not len(terms) or not len(block.size):
        return empty, empty, empty.astype(bool)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.minimum(np.searchsorted(terms, block.term), len(terms) - 1)
    there = terms[at] == block.term
    used = np.arange(WINDOW)[None, :] < block.size[:, None]
    there &= used
    # Terms by rarity, missing ones first and unused ones last; windows with too few terms here can't match nearly.
    order = np.argsort(np.where(used, np.where(there, count[at], 0), np.iinfo(np.int64).max), axis=1, kind="stable")
    spare = block.size - np.ceil(NEAR_SHARE * block.size).astype(np.int64)
    absent = block.size - there.sum(1)
    live = np.flatnonzero((absent <= spare) & (absent < block.size))
    at = np.where(there, at, -2)
    # Positions of the terms that some window uses: the lists that are intersected.  Ends are padded.
    needed = np.unique(at[there])
    pad = WINDOW + 2 * SLOP
    term_at = np.full(int(posting.max()) + 1 + 2 * pad, -1, np.int64)
    total = count[needed]
    where = posting[np.repeat(first[needed], total) + np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)]
    term_at[pad + where] = np.repeat(needed, total)
    begin = np.cumsum(n_words + GAP) - n_words - GAP
    found = [(empty, empty, empty.astype(bool))]
    for rank in range(int(spare.max()) + 1):
        own = live[(rank >= absent[live]) & (rank <= spare[live])]
        totals = np.cumsum(count[at[own, order[own, rank]]])
        cuts = np.unique(np.searchsorted(totals, np.arange(0, int(totals[-1]) + TRIED, TRIED), "right")) if len(own) else []
        for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
            part = own[a:b]
            slot = at[part, order[part, rank]]
            n = count[slot]
            window = np.repeat(part, n)
            spot = posting[np.repeat(first[slot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            start = spot - order[window, rank]
            if not len(window):
                continue
            if rank == 0:
                exact = np.flatnonzero(_reach(term_at, pad, at, order, window, start, block.size, 0, 0, 0 * spare, None))
                found.append((window[exact], start[exact], np.ones(len(exact), bool)))
            # Whatever the best start is, all matched terms are within twice SLOP of where this term puts them.
            doc = np.searchsorted(begin, spot, "right") - 1
            bounds = (begin[doc], begin[doc] + n_words[doc])
            near = np.flatnonzero(_reach(term_at, pad, at, order, window, start, block.size, rank, 2 * SLOP, spare, bounds))
            hit = np.zeros(len(near), bool)
            bounds = (bounds[0][near], bounds[1][near])
            for shift in range(-SLOP, SLOP + 1):
                hit |= _reach(term_at, pad, at, order, window[near], start[near] + shift, block.size, rank, SLOP, spare, bounds)
            near = near[hit]
            # One hit of a window in a document is enough.
            near = near[np.unique(np.stack([window[near], doc[near]]), axis=1, return_index=True)[1]]
            found.append((window[near], spot[near], np.zeros(len(near), bool)))
    return tuple(np.concatenate(columns) for columns in zip(*found, strict=True))


def _reach(term_at: np.ndarray, pad: int, at: np.ndarray, order: np.ndarray, window: np.ndarray, start: np.ndarray, size: np.ndarray, rank: int, slop: int, spare: np.ndarray, bounds: tuple | None) -> np.ndarray:
    """Which rows (window, start) miss at most ``spare`` terms, counting all terms before ``rank`` as missed."""
    live, missed = np.arange(len(window)), np.full(len(window), rank, np.int64)
    for k in range(rank + 1 if bounds is not None else 0, WINDOW):
        if not len(live):
            break
        w = window[live]
        j = order[w, k]
        place, term = start[live] + j, at[w, j]
        hit = k >= size[w]
        for slack in range(-slop, slop + 1):
            same = term_at[place + slack + pad] == term
            if bounds is not None:
                same &= (place + slack >= bounds[0][live]) & (place + slack < bounds[1][live])
            hit |= same
        missed = missed + ~hit
        stay = missed <= spare[w]
        live, missed = live[stay], missed[stay]
    out = np.zeros(len(window), bool)
    out[live] = True
    return out


def _search_batches(block: Windows) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _RESULT.names}
            for r in range(batch.num_rows):
                segment = {name: batch.column(name)[r].as_py() for name in ("terms", "counts", "positions")}
                ids = batch.column("doc_ids")[r].as_py()
                n_words = np.array(batch.column("n_words")[r].as_py(), np.int64)
                window, start, exact = lookup(segment, block, n_words)
                begin = np.cumsum(n_words + GAP) - n_words - GAP
                doc = np.searchsorted(begin, start, "right") - 1
                items, near_items, hits = ([[] for _ in ids] for _ in range(3))
                for d in np.unique(doc).tolist():
                    own = np.flatnonzero(doc == d)
                    full = own[exact[own]]
                    where = np.unique(np.stack([start[full] - begin[d], block.size[window[full]]], 1), axis=0)
                    items[d] = sorted({block.item[w] for w in window[full]})
                    near_items[d] = sorted({block.item[w] for w in window[own]})
                    hits[d] = [{"at": int(x), "size": int(n)} for x, n in where]
                out["segment"] += [batch.column("segment")[r].as_py()] * len(ids)
                out["row"] += range(len(ids))
                out["doc_id"] += ids
                out["n_words"] += n_words.tolist()
                out["items"] += items
                out["near_items"] += near_items
                out["hits"] += hits
            yield pa.RecordBatch.from_pydict(out, schema=_RESULT)

    return run


RESULT = "segment string, row int, doc_id long, n_words long, items array<long>, near_items array<long>, hits array<struct<at:int,size:int>>"
_IDS = pa.list_(pa.int64())
_RESULT = pa.schema([("segment", pa.string()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("items", _IDS), ("near_items", _IDS), ("hits", pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32())])))])


def search(index: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: its items and the word ranges of their windows.

    The benchmark streams through the driver in blocks of at most WINDOW_BLOCK windows, one at a time.
    A benchmark of one block is a single pass over the index; with several, each block's hits are
    written before the next block is read, and joined with the index's documents at the end.
    """
    rows = ((r["item_id"], r["text"]) for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id").toLocalIterator())
    blocks = windows(rows)
    first = next(blocks, Windows([], np.zeros((0, WINDOW), np.uint64), np.zeros(0, np.int64)))
    second = next(blocks, None)
    if second is None:
        return index.mapInArrow(tidy(_search_batches(first)), RESULT)

    def hits(block: Windows) -> DataFrame:
        return staged(index.mapInArrow(tidy(_search_batches(block)), RESULT).where("size(near_items) > 0").select("segment", "row", "items", "near_items", "hits"), "window-hits")

    parts = [hits(first), hits(second)]
    parts += [hits(block) for block in blocks]
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items", "hits")]
    # One entry from each block at most, so what is gathered for a document is what its row returns.
    gathered = reduce(DataFrame.unionAll, parts).groupBy("segment", "row").agg(*lists)
    every = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("row", "d")).select("segment", "row", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
    full = every.join(gathered, ["segment", "row"], "left")
    empty = {c: F.coalesce(F.col(c), F.array().cast(index.sparkSession.createDataFrame([], RESULT).schema[c].dataType)).alias(c) for c in ("items", "near_items", "hits")}
    return full.select("segment", "row", "doc_id", "n_words", *empty.values())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the items near by.

    n_hit counts the words inside occurrences of windows; near_items has the items with an exact or
    proximity match.
    """
    found = search(build_index(docs), benchmark)
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    # Ranges are merged in order: each adds what reaches beyond the furthest end so far.
    step = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, h: F.struct(
            (acc["n"] + F.greatest(F.lit(0), h["at"] + h["size"] - F.greatest(h["at"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], h["at"] + h["size"]).alias("end"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    out = found.select(
        "doc_id",
        "n_words",
        step.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        "near_items",
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with all their columns; a null id always stays."""
    hit = contamination(docs, benchmark).where("contaminated").select("doc_id").distinct()
    return without(docs, hit)
