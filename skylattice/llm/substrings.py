"""Exact substring deduplication by longest-previous-factor arrays over suffix orders.

Every byte covered by a ``LENGTH``-byte string that also starts in a document of smaller id goes.

1. Documents are packed into chunks, compressed and written once to the shared folder.
2. Each window of LENGTH bytes is represented by its minimiser: the k-gram in it of least hash.
   Equal windows have equal minimisers at equal places.  Chunks send the hashes of their distinct
   minimisers to buckets, which answer for each: does it occur in two documents, and is it hot?
3. For the minimisers that do, chunks send the segment of text around each, once for each distinct
   segment and with the least id that holds it.  Segments of a hot minimiser are sent window by
   window to the bucket of the whole window's hash, so no minimiser is one bucket's burden.
   A bucket sorts the suffixes of its segments (to LENGTH bytes, equal ones by id) and takes the
   lengths of the neighbours' common prefixes.  The longest previous factor of a suffix is the longer
   of its common prefixes with the previous and the next suffix in that order that have a smaller id.
   The bucket answers with one bit for each window: its factor reaches LENGTH bytes.
4. Chunks mark the bytes of the windows with such factors and cut them out; what stays is the copy
   in the document of the least id.

A string that occurs in any number of documents is one entry from each chunk.  Null texts are empty;
rows that repeat an id don't count as earlier for each other.  Ties between equal suffixes go by id.
Very long texts are chunks of their own, hashed in blocks.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, answered, ask, buckets_for, packed, unpack
from .common import mix

LENGTH = 50
#: Bytes of a minimiser.
GRAM = 20
#: Bytes whose hashes are held at once.
BLOCK = 1 << 16
#: Occurrences in a chunk from which a minimiser's distinct segments are counted, and their number over
#: all chunks from which it is hot.  Both only decide where windows meet, not what is found.
COUNTED, HOT_SEGMENTS = 64, 20_000

#: Low bits of a compared key: the place within a block, which is shorter than this.
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Mixed hash of the k-gram at each byte, by doubling."""
    n = len(raw)
    if n < gram:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        powers = {1: (raw.astype(np.uint64) + np.uint64(1), base)}
        width = 1
        while width * 2 <= gram:
            h, b = powers[width]
            powers[width * 2] = (h[:-width] * b + h[width:], b * b)
            width *= 2
        out, at = None, 0
        for width in sorted(powers, reverse=True):
            if gram & width:
                h, b = powers[width]
                part = h[at : at + n - gram + 1]
                out = part if out is None else out * b + part
                at += width
    return mix(out)


def minimisers(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window inside one row: its start, the place of its minimiser and the k-gram's hash.

    The minimiser is the k-gram of least leading hash bits, of equal ones the first: the place stands
    in the low bits of the compared keys, so a running minimum gives it at once.
    """
    n = len(raw)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = np.diff(offsets)
    marks = np.zeros(n + 1, np.int32)
    long_enough = size >= length
    np.add.at(marks, offsets[:-1][long_enough], 1)
    np.add.at(marks, (offsets[1:] - length + 1)[long_enough], -1)
    h = gram_hashes(raw, gram)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    m = len(h) - (length - gram)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:m], least[span - width : span - width + m])
    windows = np.flatnonzero(np.cumsum(marks[:m]) > 0)
    place = (least[windows] & _PLACE).astype(np.int64)
    return windows, place, h[place]


class Segments:
    """Runs of windows of one document that share a minimiser place."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> None:
        parts: list[tuple[np.ndarray, ...]] = []
        at, n_docs = 0, len(offsets) - 1
        while at < n_docs:  # whole documents, about BLOCK bytes at a time: hashes take 8 bytes a byte
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            if to == at + 1 and offsets[to] - offsets[at] > 2 * BLOCK:  # a long document, in pieces that overlap by a window
                for cut in range(int(offsets[at]), int(offsets[to]), BLOCK):
                    piece = np.array([cut, min(cut + BLOCK + length - 1, int(offsets[to]))])
                    parts.append(self._block(raw[piece[0] : piece[1]], piece, at, length, gram))
            else:
                parts.append(self._block(raw[offsets[at] : offsets[to]], offsets[at : to + 1], at, length, gram))
            at = to
        none = np.zeros(0, np.int64)
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [none, none, none, none, np.zeros(0, np.uint64)]
        self.start, self.run, self.doc, self.place, self.hash = joined

    @staticmethod
    def _block(raw: np.ndarray, offsets: np.ndarray, first_doc: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
        base = int(offsets[0])
        windows, place, value = minimisers(raw, offsets - base, length, gram)
        fresh = np.ones(len(windows), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
        first = np.flatnonzero(fresh)
        start = windows[first]
        run = np.diff(np.append(first, len(windows)))
        doc = np.searchsorted(offsets[1:] - base, start, "right") + first_doc
        return start + base, run, doc, place[first] + base, value[first]


def _first_request(length: int, gram: int) -> object:
    """Distinct minimisers of a chunk, by bucket: hashes, a bit for two documents within it, and the
    places and numbers of those with many distinct segments."""

    def make(chunk: dict, buckets: int) -> Iterator[tuple[int, bytes]]:
        s = Segments(chunk["raw"], chunk["offsets"], length, gram)
        unique, flag, segments = _distinct(s, chunk["ids"], chunk["raw"], length)
        bucket = (unique >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[cut[b] : cut[b + 1]]
            if len(own):
                many = np.flatnonzero(segments[own])
                head = np.array([len(own), len(many)], np.int64)
                yield b, head.tobytes() + unique[own].tobytes() + many.tobytes() + segments[own[many]].tobytes() + np.packbits(flag[own]).tobytes()

    return make


def _distinct(s: Segments, ids: np.ndarray, raw: np.ndarray | None = None, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct minimiser hashes, whether each occurs in rows of two ids, and the number of distinct
    segments of those that occur often (else 0)."""
    order = np.argsort(s.hash, kind="stable")
    h, doc = s.hash[order], ids[s.doc[order]]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    if not len(first):
        return h, np.zeros(0, bool), np.zeros(0, np.int64)
    segments = np.zeros(len(first), np.int64)
    if raw is not None:
        size = np.diff(np.append(first, len(h)))
        for k in np.flatnonzero(size >= COUNTED).tolist():
            own = order[first[k] : first[k] + size[k]]
            segments[k] = len({(raw[x : x + n + length - 1].tobytes(), p - x) for x, n, p in zip(s.start[own].tolist(), s.run[own].tolist(), s.place[own].tolist(), strict=True)})
    return h[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), segments


def _split(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    at = 16 + 8 * n
    return np.frombuffer(data, np.uint64, n, 16), np.frombuffer(data, np.int64, m, at), np.frombuffer(data, np.int64, m, at + 8 * m), np.unpackbits(np.frombuffer(data, np.uint8, offset=at + 16 * m), count=n).astype(bool)


def _repeated(requests: list[bytes]) -> list[bytes]:
    """For each request two bits per hash: it occurs in two documents of the corpus, and it is hot."""
    parts = [_split(r) for r in requests]
    ends = np.cumsum([len(p[0]) for p in parts])
    every = np.concatenate([p[0] for p in parts])
    order = np.argsort(every, kind="stable")
    h, flag = every[order], np.concatenate([p[3] for p in parts])[order]
    segments = np.zeros(len(every), np.int64)
    for p, e in zip(parts, ends, strict=True):
        segments[e - len(p[0]) + p[1]] = p[2]
    fresh = np.append(True, h[1:] != h[:-1])
    first, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    twice = (np.diff(np.append(first, len(h))) > 1) | np.logical_or.reduceat(flag, first)
    hot = twice & (np.add.reduceat(segments[order], first) >= HOT_SEGMENTS)
    out = np.empty((2, len(h)), bool)
    out[:, order] = np.stack([twice, hot])[:, group]
    return [np.packbits(out[:, e - len(p[0]) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]


class Shared:
    """Distinct segments of a chunk around repeated minimisers, by bucket.

    ``rows_*`` and ``code`` are the segments in text order and the distinct ones they equal.
    """

    def __init__(self, chunk: dict, replies: dict[int, bytes], buckets: int, length: int, gram: int) -> None:
        raw, ids = chunk["raw"], chunk["ids"]
        s = Segments(raw, chunk["offsets"], length, gram)
        unique, _, _ = _distinct(s, ids)
        bucket = ((unique >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        marks = np.zeros((2, len(unique)), bool)
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, data in replies.items():
            own = order[cut[b] : cut[b + 1]]
            marks[:, own] = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * len(own)).reshape(2, -1).astype(bool)
        of = np.searchsorted(unique, s.hash) if len(unique) else np.zeros(0, np.int64)
        repeated, hot = marks[:, of] if len(unique) else np.zeros((2, 0), bool)
        rows, wide = np.flatnonzero(repeated & ~hot), np.flatnonzero(hot)
        blob = raw.tobytes()
        # Each window of a hot minimiser is a segment by itself, known by the hash of all its bytes.
        each = s.run[wide]
        alone = np.repeat(s.start[wide], each) + _steps(each)
        keys = np.array([xxhash.xxh64_intdigest(blob[x : x + length]) for x in alone.tolist()], np.uint64)
        self.rows_start = np.concatenate([s.start[rows], alone])
        self.rows_run = np.concatenate([s.run[rows], np.ones(len(alone), np.int64)])
        self.rows_doc = np.concatenate([s.doc[rows], np.repeat(s.doc[wide], each)])
        hashes = np.concatenate([s.hash[rows], keys])
        shift = np.concatenate([(s.place - s.start)[rows], np.full(len(alone), -1)])
        # Distinct segments (hash, bytes and the minimiser's place in them), each with the least id that holds it.
        seen: dict[tuple[int, bytes, int], int] = {}
        ends = self.rows_start + self.rows_run + length - 1
        self.code = np.fromiter((seen.setdefault((h, blob[x:y], k), len(seen)) for h, x, y, k in zip(hashes.tolist(), self.rows_start.tolist(), ends.tolist(), shift.tolist(), strict=True)), np.int64, len(hashes))
        self.least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.code, ids[self.rows_doc])
        self.text = [k[1] for k in seen]
        self.run = np.fromiter((len(t) - length + 1 for t in self.text), np.int64, len(seen))
        self.hash = np.array([k[0] for k in seen], np.uint64)
        self.bucket = ((self.hash >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _steps(run: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n."""
    return np.arange(int(run.sum())) - np.repeat(np.cumsum(run) - run, run)


def _second_request(length: int, gram: int) -> object:
    def make(chunk: dict, buckets: int) -> Iterator[tuple[int, bytes]]:
        shared = Shared(chunk, chunk["replies"], buckets, length, gram)
        order = np.argsort(shared.bucket, kind="stable")
        cut = np.searchsorted(shared.bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[cut[b] : cut[b + 1]].tolist()
            if own:
                texts = [shared.text[i] for i in own]
                head = np.array([len(own)], np.int64)
                size = np.array([len(t) for t in texts], np.int64)
                yield b, head.tobytes() + shared.hash[own].tobytes() + shared.least[own].tobytes() + size.tobytes() + b"".join(texts)

    return make


def _earlier(length: int) -> object:
    """For each request one bit per window of each segment: it also starts in a smaller id's document."""

    def answer(requests: list[bytes]) -> list[bytes]:
        hashes, ids, sizes, blobs, owner = [], [], [], [], []
        for r, data in enumerate(requests):
            n = int(np.frombuffer(data, np.int64, 1)[0])
            hashes.append(np.frombuffer(data, np.uint64, n, 8))
            ids.append(np.frombuffer(data, np.int64, n, 8 + 8 * n))
            sizes.append(np.frombuffer(data, np.int64, n, 8 + 16 * n))
            blobs.append(data[8 + 24 * n :])
            owner.append(np.full(n, r))
        h, doc, size, owner = (np.concatenate(x) for x in (hashes, ids, sizes, owner))
        raw = np.frombuffer(b"".join(blobs), np.uint8)
        begin = np.cumsum(size) - size
        run = size - length + 1
        # Equal segments in two chunks: the later id has an earlier factor in every window.
        text = raw.tobytes()
        seen: dict[tuple[int, bytes], int] = {}
        code = np.fromiter((seen.setdefault((k, text[a : a + n]), len(seen)) for k, a, n in zip(h.tolist(), begin.tolist(), size.tolist(), strict=True)), np.int64, len(h))
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, code, doc)
        total = np.cumsum(run) - run
        hit = np.repeat(doc > least[code], run)
        # One copy of each distinct segment enters the suffix order, where its minimiser has others.
        _, first = np.unique(code, return_index=True)
        first = first[np.argsort(h[first], kind="stable")]
        group = h[first]
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        many = np.repeat(np.diff(np.append(edge, len(group))) > 1, np.diff(np.append(edge, len(group))))
        chosen = first[many]
        if len(chosen):
            rep_of = np.full(len(seen), -1, np.int64)
            rep_of[code[chosen]] = np.arange(len(chosen))
            found = longest_previous_factors(raw, begin[chosen], run[chosen], least[code[chosen]], length) >= length
            offset = np.cumsum(run[chosen]) - run[chosen]
            own = np.flatnonzero((rep_of[code] >= 0) & (doc == least[code]))
            n, step = run[own], _steps(run[own])
            hit[np.repeat(total[own], n) + step] |= found[np.repeat(offset[rep_of[code[own]]], n) + step]
        ends = np.cumsum(np.bincount(owner, run, len(requests)).astype(np.int64))
        return [np.packbits(part).tobytes() for part in np.split(hit, ends[:-1])]

    return answer


def longest_previous_factors(raw: np.ndarray, begin: np.ndarray, run: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each suffix (window) of the segments the length, at most ``length``, of its longest factor that
    also starts in a segment of smaller id.

    Suffixes are sorted by their first ``length`` bytes and then by id.  Of all suffixes of smaller id
    the nearest before and the nearest after in that order share the longest prefixes.
    """
    at = np.repeat(begin, run) + _steps(run)
    owner = np.repeat(doc, run)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(raw) + 1,), ">u8", padded, strides=(1,))
    keys = []
    for w in range(-(-length // 8)):
        left = min(8, length - 8 * w)
        keys.append(blocks[at + 8 * w].astype(np.uint64) & ~np.uint64((1 << 8 * (8 - left)) - 1))
    order = np.lexsort((owner, *keys[::-1]))
    # Common prefix of each suffix with the one before it, in bytes.
    common, open_ = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for w, key in enumerate(keys):
        left = min(8, length - 8 * w)
        differ = key[order[open_]] ^ key[order[open_ - 1]]
        some = differ > 0
        same = np.full(len(open_), 8)
        same[some] = (differ[some].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
        common[open_] += np.minimum(same, left)
        open_ = open_[~some]
    own = owner[order]
    common[:1] = 0
    factor = np.zeros(len(order), np.int64)
    np.maximum(_to_smaller(own, common), _to_smaller(own[::-1], np.append(common[1:], 0)[::-1])[::-1], out=factor)
    out = np.empty(len(order), np.int64)
    out[order] = factor
    return out


def _to_smaller(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix of each entry with the nearest one before it of smaller value; zero without one.

    ``common`` is that of each entry with the one before.  Least values and least common prefixes of
    blocks of 1, 2, 4, ... entries are laid out once; every entry then goes up past blocks without a
    smaller value and down into the first that has one, so the steps are as many as the logarithm of
    the entries, whatever their order.
    """
    n = len(value)
    # Common prefixes are short and places fit 32 bits: the layouts stay small.
    common = common.astype(np.uint8 if n and common.max() < 255 else np.int32)
    values, commons = [value], [common]
    while len(values[-1]) > 1:
        for levels in (values, commons):
            even = np.append(levels[-1], np.iinfo(levels[-1].dtype).max) if len(levels[-1]) % 2 else levels[-1]
            levels.append(np.minimum(even[::2], even[1::2]))
    out = np.zeros(n, np.int64)
    # Of each entry that still goes up: itself, its block, and the least common prefix back to the block's start.
    entry, block, least = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32), common.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(len(values)):
        right = np.flatnonzero(block & 1)
        left = block[right] - 1
        here = values[k][left] < value[entry[right]]
        hit = right[here]
        found.append((entry[hit], block[hit] - 1, least[hit]))
        past = right[~here]
        least[past] = np.minimum(least[past], commons[k][block[past] - 1])
        # An entry leaves when it has found a block, at the first place, and where nothing is shared any more.
        stay = least > 0
        stay[hit] = False
        stay &= block > 0
        entry, block, least = entry[stay], block[stay] >> 1, least[stay]
        if not len(entry):
            break
    entry, block, least = entry[:0], block[:0], least[:0]
    for k in range(len(found) - 1, -1, -1):
        entry, block, least = (np.concatenate(x) for x in zip((entry, block, least), found.pop(), strict=True))
        if k:
            right = np.minimum(2 * block + 1, len(values[k - 1]) - 1)
            there = (2 * block + 1 < len(values[k - 1])) & (values[k - 1][right] < value[entry])
            skip = ~there & (2 * block + 1 < len(values[k - 1]))
            least[skip] = np.minimum(least[skip], commons[k - 1][right[skip]])
            block = 2 * block + there.astype(np.int32)
    out[entry] = least
    return out


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _finish(length: int, gram: int, texts: bool) -> object:
    def make(chunk: dict, buckets: int) -> Iterator[pa.RecordBatch]:
        raw, offsets = chunk["raw"], chunk["offsets"]
        shared = Shared(chunk, chunk["replies"], buckets, length, gram)
        run = shared.run
        order = np.argsort(shared.bucket, kind="stable")
        cut = np.searchsorted(shared.bucket[order], np.arange(buckets + 1))
        # The answers of all distinct segments, one after the other in the order of the buckets.
        hits = np.zeros(int(run.sum()), bool)
        ends = np.cumsum(run[order])
        for b, data in chunk["more"].items():
            lo, hi = cut[b], cut[b + 1]
            first = int(ends[lo - 1]) if lo else 0
            hits[first : int(ends[hi - 1])] = np.unpackbits(np.frombuffer(data, np.uint8), count=int(ends[hi - 1]) - first).astype(bool)
        place = np.empty(len(run), np.int64)
        place[order] = ends - run[order]
        edges = np.zeros(len(raw) + 1, np.int32)
        ids = chunk["ids"]
        # A segment that equals one of a smaller id goes whole; of the others the windows that were hit.
        later = ids[shared.rows_doc] > shared.least[shared.code]
        np.add.at(edges, shared.rows_start[later], 1)
        np.add.at(edges, shared.rows_start[later] + shared.rows_run[later] + length - 1, -1)
        rest = np.flatnonzero(~later)
        n, step = shared.rows_run[rest], _steps(shared.rows_run[rest])
        found = hits[np.repeat(place[shared.code[rest]], n) + step]
        where = (np.repeat(shared.rows_start[rest], n) + step)[found]
        np.add.at(edges, where, 1)
        np.add.at(edges, where + length, -1)
        gone = np.cumsum(edges[:-1]) > 0
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for d, doc_id in enumerate(chunk["id_list"]):
            own = slice(offsets[d], offsets[d + 1])
            cut_out = gone[own]
            rest = raw[own][~cut_out].tobytes()
            out["doc_id"].append(doc_id)
            out["n_bytes"].append(len(cut_out))
            out["n_removed"].append(int(cut_out.sum()))
            out["n_spans"].append(int(np.count_nonzero(cut_out[1:] & ~cut_out[:-1]) + (len(cut_out) > 0 and cut_out[0])))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["kept"].append(rest.decode("utf-8", "ignore") if texts else None)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]))

    return make


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, the kept text.

    Cuts are made at bytes; a character cut apart is left out of the kept text (not of the digest).
    """
    table = packed(docs, "substrings", CHUNK_BYTES)
    buckets = buckets_for(table)
    first = ask(table, _first_request(length, gram), buckets)
    with_first = answered(table, first, _repeated, "replies")
    second = ask(with_first, _second_request(length, gram), buckets)
    with_both = answered(with_first, second, _earlier(length), "more")
    make = _finish(length, gram, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in unpack(batches):
            yield from make(chunk, buckets)

    out = with_both.mapInArrow(run, OUT)
    return out if texts else out.drop("kept")
