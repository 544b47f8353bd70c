"""Near duplicates by exact Jaccard similarity of word shingles, found by prefix filtering.

A text is the set of the hashes of its five-word shingles (fewer words are one shingle).  Let all
hashes have one order.  Two sets of similarity 4/5 or more then share an element among the first
``n - ceil(4 n / 5) + 1`` of each set of n, so these prefixes are the keys and no pair is missed.
Hashes that many documents hold come last in the order, which only keeps buckets small.

Equal sets are one node.  Candidates found another way (the pipeline gives those of the fingerprints)
are verified first, then each node of a bucket of unconnected ones against a hub or two, those it shares
most buckets with.  Of all other pairs whose nodes aren't connected yet none is left out:

* nodes of the same hub, their frame, are held by what they have more and less than it.  Two sets that
  aren't both similar to the frame need many common differences to be similar, so prefixes of the
  differences, rarest first, are the keys: a group of edited copies is no bucket of all pairs;
* nodes of different frames meet in the buckets of their prefixes.

In both, the place of a common key bounds what the sets can share after it.  The pairs that are left are
verified too, so the components are those of all similar pairs.

Before any verification a small bitmap of each set (``sketch``) bounds from above what two sets share.  Whole
sets are made and sent only for pairs that the bound allows, so it costs bytes, never a pair.

Hashes are counted, and keys meet, as packed messages to buckets (see ``chunks``): a shingle is never a
row of its own, only a key that several sets share.

A null or blank text has the empty set; blank texts equal each other and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .chunks import BUCKET_BYTES
from .common import LOWER, SPACE, documents, give_back, hash_words, mix, short_batches, shuffle_partitions, staged, text_buffer, tidy, word_spans

#: Words of a shingle, and the least similarity as a fraction.
WIDTH, SHARE = 5, (4, 5)
#: Sets in buckets of more than this have so many hubs at first (others one).
PAIRED_BUCKET, HUBS = 32, 2
#: Share of the hashes, from the least on, that are counted over all documents for the order (prefixes hold
#: the least); documents from which a hash is frequent, and such hashes at most, the most frequent ones.
COUNTED_SHARE, FREQUENT, MAX_FREQUENT = 0.4, 33, 200_000
#: Bits of a set's bitmap for each of its hashes, at least (the next power of two).
SKETCH_BITS = 2
#: Least similarity, as a fraction, of a set to the hub that is its frame.
FRAME_SHARE = (1, 3)
#: Pairs of mark and id (16 bytes each) that are broadcast at most.
BROADCAST_IDS = 1_000_000
#: Entries that a task gathers before it sends them to the buckets.
HELD = 1 << 18
#: A hash with its number, and a key of a set, as they are sent.
COUNT = np.dtype([("h", "<u8"), ("count", "<i8")])
KEY = np.dtype([("key", "<u8"), ("mark", "<i8"), ("size", "<i4"), ("place", "<i4")])

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x94D049BB133111EB], np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = text_buffer(texts)
    low = LOWER[raw]
    starts, ends = word_spans(~SPACE[low], offsets)
    words = hash_words(low, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own, n = words[a:b], max(1, b - a - WIDTH + 1)
            width = min(WIDTH, b - a)
            total = np.full(n if width else 0, width, np.uint64)
            for i in range(width):
                total += own[i : i + n] * _ODD[i]
            out.append(np.unique(mix(total)))
    return out


def prefix_length(n: int) -> int:
    return n - -(-SHARE[0] * n // SHARE[1]) + 1 if n else 0


def sketch(own: np.ndarray) -> bytes:
    """Bitmap of the set: the bit of each hash's low bits is one."""
    bits = 1 << max(3, (SKETCH_BITS * len(own) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[own & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def can_share(size_x: int, x: bytes, size_y: int, y: bytes) -> int:
    """Hashes that two sets have in common at most, by their sizes and bitmaps: each bit that only one of them has
    is a hash that the other lacks."""
    n = min(len(x), len(y))
    # The longer bitmap is folded to the length of the shorter one, whose bits are fewer low bits of the hash.
    a, b = (np.bitwise_or.reduce(np.frombuffer(v, np.uint8).reshape(-1, n), axis=0) for v in (x, y))
    return min(size_x - int(np.bitwise_count(a & ~b).sum()), size_y - int(np.bitwise_count(b & ~a).sum()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        yield batch, shingle_sets(batch.column("text"))


def _mark(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def buckets_for(docs: DataFrame) -> int:
    """Buckets in proportion to the text, at least one for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, shuffle_partitions(docs.sparkSession), -(-total // BUCKET_BYTES))


def _planes(entries: np.ndarray) -> bytes:
    """The entries byte by byte, all first bytes first: what is zero in all of them shrinks in the shuffle."""
    return np.ascontiguousarray(entries).view(np.uint8).reshape(len(entries), entries.dtype.itemsize).T.tobytes()


def _read(messages: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(m, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind) for m in messages.to_pylist()]
    return np.concatenate([np.empty(0, kind), *parts])


def _sent(entries: np.ndarray, by: str, buckets: int) -> pa.RecordBatch:
    """A message ``(bucket, data)`` to each bucket that gets any of the entries."""
    bucket = (entries[by] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    to, starts = np.unique(bucket[order], return_index=True)
    data = [_planes(part) for part in np.split(entries[order], starts[1:])] if len(to) else []
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])


def _counts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Entries of the distinct hashes with the sums of their numbers."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    out = np.empty(len(first), COUNT)
    out["h"], out["count"] = h[first], np.add.reduceat(n, first) if len(first) else 0
    return out


def _count_batches(buckets: int) -> object:
    limit = np.uint64(int(COUNTED_SHARE * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, sets in _slices(batches):
            held += [own[: np.searchsorted(own, limit)] for own in sets]
            n += sum(len(own) for own in held[-len(sets) :]) if sets else 0
            if n >= HELD:
                yield _sent(_counts(np.concatenate(held), np.ones(n, np.int64)), "h", buckets)
                held, n = [], 0
        if n:
            yield _sent(_counts(np.concatenate(held), np.ones(n, np.int64)), "h", buckets)

    return run


def _frequent_of(table: pa.Table) -> pa.Table:
    rows = _read(table.column("data"), COUNT)
    rows = _counts(rows["h"], rows["count"])
    rows = rows[rows["count"] >= FREQUENT]
    give_back()
    return pa.table({"h": pa.array(rows["h"].view(np.int64)), "count": pa.array(rows["count"])})


def frequent_hashes(docs: DataFrame, buckets: int) -> np.ndarray:
    """The frequent hashes, sorted; any such list gives the same result."""
    counts = docs.mapInArrow(tidy(_count_batches(buckets)), "bucket int, data binary").groupBy("bucket").applyInArrow(_frequent_of, "h long, count long")
    rows = counts.orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).select("h").toArrow()
    return np.sort(np.array(rows.column("h").combine_chunks(), np.int64).view(np.uint64))


def _prefix_batches(frequent: np.ndarray) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _slices(batches):
            prefixes = []
            for own in sets:
                n = prefix_length(len(own))
                if len(frequent):
                    common = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
                    own = own[np.argsort(common, kind="stable")[:n]]
                prefixes.append(own[:n].tobytes())
            marks = pa.array([_mark(s) for s in sets], pa.int64())
            columns = [batch.column("doc_id"), marks, pa.array([len(s) for s in sets], pa.int32()), pa.array(prefixes, pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "size", "prefix", "sketch"])

    return run


def _key_batches(buckets: int) -> object:
    def entries(batch: pa.RecordBatch) -> np.ndarray:
        parts = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
        n = np.array([len(p) for p in parts], np.int64)
        out = np.empty(int(n.sum()), KEY)
        out["key"] = np.concatenate([np.zeros(0, np.uint64), *parts])
        out["mark"], out["size"] = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in ("mark", "size"))
        out["place"] = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            held.append(entries(batch))
            n += len(held[-1])
            if n >= HELD:
                yield _sent(np.concatenate(held), "key", buckets)
                held, n = [], 0
        if n:
            yield _sent(np.concatenate(held), "key", buckets)

    return run


def _shared_of(table: pa.Table) -> pa.Table:
    rows = _read(table.column("data"), KEY)
    rows = rows[np.lexsort((rows["mark"], rows["key"]))]
    # A repeated row is one.
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["mark"][1:] != rows["mark"][:-1])
    rows = rows[fresh]
    _, at, n = np.unique(rows["key"], return_inverse=True, return_counts=True)
    n = n[at]
    rows, n = rows[n > 1], n[n > 1]
    give_back()
    columns = {c: np.ascontiguousarray(rows[c]) for c in KEY.names}
    return pa.table({"key": columns["key"].view(np.int64), "mark": columns["mark"], "size": columns["size"], "place": columns["place"], "n": n.astype(np.int64)})


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: set[int] = set()
    for batch, sets in _slices(batches):
        # A repeated id has other texts too; the set that was asked for is the one of its mark, once from each task.
        rows = []
        for i, (own, mark) in enumerate(zip(sets, batch.column("mark").to_pylist(), strict=True)):
            if mark not in done and _mark(own) == mark:
                done.add(mark)
                rows.append(i)
        yield pa.RecordBatch.from_arrays([batch.column("mark").take(pa.array(rows, pa.int64())), pa.array([sets[i].tobytes() for i in rows], pa.binary())], ["mark", "hashes"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("x"), batch.column("y")
        keep = [similar(np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64)) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _likely_batches(share: tuple[int, int]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, a, n_b, b = (batch.column(c).to_pylist() for c in ("a_size", "a_sketch", "b_size", "b_sketch"))
            keep = [sum(share) * can_share(n_a[i], a[i], n_b[i], b[i]) >= share[0] * (n_a[i] + n_b[i]) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def likely(pairs: DataFrame, least: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """Those of ``pairs(a, b)`` that can have the similarity, by the bitmaps."""
    side = lambda n: least.select(F.col("mark").alias(n), F.col("size").alias(f"{n}_size"), F.col("sketch").alias(f"{n}_sketch"))
    return staged(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(_likely_batches(share)), "a long, b long"), "shingle-likely")


def sets_of(marks: DataFrame, least: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """``mark, hashes`` of ``marks(mark)``, made again from one text each; a repeated row may give its set again."""
    asked = staged(marks.distinct().join(least.select("mark", "doc_id"), "mark"), f"{name}-asked")
    # The texts stay where they are while the ids asked for fit in a broadcast; beyond, both sides are shuffled.
    few = asked.count() <= BROADCAST_IDS
    return staged(docs.join(F.broadcast(asked) if few else asked, "doc_id").select("mark", "text").mapInArrow(tidy(_set_batches), "mark long, hashes binary"), name)


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = sets.select(F.col("mark").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("mark").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of ``pairs(a, b)``."""
    return staged(_met(pairs, sets).mapInArrow(tidy(_verify_batches), "a long, b long").distinct(), "shingle-links")


def linked(pairs: DataFrame, least: DataFrame, docs: DataFrame) -> DataFrame:
    """The similar ones of ``pairs(a, b)``; sets are made for those only that can be similar."""
    pairs = likely(pairs, least)
    return verified(pairs, sets_of(_both(pairs), least, docs, "shingle-sets"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("mark")).union(pairs.select(F.col("b").alias("mark")))


def _close(x: str, y: str) -> object:
    """Sizes that allow the similarity."""
    least, most = F.least(x, y), F.greatest(x, y)
    return least * SHARE[1] >= most * SHARE[0]


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of marks of different roots and frames that can be similar: of their common keys the first leaves
    enough hashes behind it in either set (the order of the hashes is one for all)."""
    side = lambda n: rows.select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("mark", "size", "place", "root", "frame")])
    apart = "mark_a < mark_b and root_a <> root_b and not coalesce(frame_a = frame_b or frame_a = mark_b or frame_b = mark_a, false)"
    enough = f"{sum(SHARE)} * least(size_a - place_a, size_b - place_b) >= {SHARE[0]} * (size_a + size_b)"
    both = side("a").join(side("b"), "key").where(apart).where(_close("size_a", "size_b")).where(enough)
    return both.select(F.col("mark_a").alias("a"), F.col("mark_b").alias("b")).distinct()


def _stars(shared: DataFrame) -> DataFrame:
    """``mark, hub, place``: the hubs that each mark shares most buckets with.  The hub of a bucket is the mark
    that shares most with others in all, in a group of edited copies that with fewest edits."""
    score = shared.groupBy("mark").agg(F.sum("n").alias("score"))
    best = F.max(F.struct("score", F.xxhash64("mark").alias("h"), F.col("mark").alias("hub"), F.col("size").alias("hub_size")))
    hub = shared.join(score, "mark").groupBy("key").agg(best.alias("s")).select("key", "s.score", "s.hub", "s.hub_size")
    met = shared.join(hub, "key").where("mark <> hub").where(_close("size", "hub_size"))
    each = met.groupBy("mark", "hub").agg(F.count("*").alias("c"), F.max("score").alias("score"), F.max(F.col("n") > PAIRED_BUCKET).alias("large"))
    # A mark has at most one hub for each of its keys here; the best of them stay.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), (-F.col("score")).alias("s"), "hub")))
    best = each.groupBy("mark").agg(F.slice(ranked, 1, F.when(F.max("large"), HUBS).otherwise(1)).alias("hubs"))
    return best.select("mark", F.posexplode("hubs.hub").alias("place", "hub"))


def _difference_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
        rows, keys, weight, slack = [], [], [], []
        for i in range(batch.num_rows):
            own, hub = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("x", "y"))
            more, less = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
            if FRAME_SHARE[1] * (len(hub) - len(less)) >= FRAME_SHARE[0] * (len(hub) + len(more)):
                rows.append(i)
                keys.append(np.concatenate([more, ~less]))
                weight.append(SHARE[1] * len(less) + SHARE[0] * len(more))
                slack.append((SHARE[1] - SHARE[0]) * len(hub))
        n = [len(k) for k in keys]
        spread = lambda v: pa.array(np.repeat(np.array(v, np.int64), n))
        columns = [batch.column(c).take(pa.array(np.repeat(np.array(rows, np.int64), n))) for c in ("a", "b")]
        key = pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))
        yield pa.RecordBatch.from_arrays([*columns, key, spread(n), spread(weight), spread(slack)], ["mark", "frame", "key", "n", "weight", "slack"])


def differences(frames: DataFrame, sets: DataFrame) -> DataFrame:
    """What each mark has more and less than its frame (less: inverted hashes), one row for each hash, and the
    mark's number of them, its weight ``5 less + 4 more`` and the slack, a fifth of the frame's size in fifths.

    With o common differences, two sets of one frame are similar just if ``9 o >= weight_a + weight_b - slack``;
    a set is similar to the frame itself just if its weight is at most the slack.
    """
    pairs = frames.select(F.col("mark").alias("a"), F.col("frame").alias("b"))
    return staged(_met(pairs, sets).mapInArrow(tidy(_difference_batches), "mark long, frame long, key long, n long, weight long, slack long").distinct(), "shingle-differences")


def _framed_pairs(differences: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of one frame and different roots that can be similar.

    At least one of them, a, isn't similar to the frame, so ``9 o > weight_b``, and ``9 o >= weight_a - slack``.
    Either bounds the number of common differences from below, so a prefix of each, rarest first, holds one,
    and the first common one leaves enough of them behind it on both sides.
    """
    whole = sum(SHARE)
    counted = differences.withColumn("held", F.count("*").over(Window.partitionBy("frame", "key")))
    place = F.row_number().over(Window.partitionBy("mark", "frame").orderBy("held", "key"))
    placed = _rooted(counted.withColumn("place", place).where("held > 1"), roots)
    side = lambda x, n: x.select("frame", "key", *[F.col(c).alias(f"{c}_{n}") for c in ("mark", "root", "n", "weight", "slack", "place")])
    far = side(placed.where("weight > slack").where(f"place <= n + 1 - (weight - slack + {whole - 1}) div {whole}"), "a")
    every = side(placed.where(f"place <= n - weight div {whole}"), "b")
    met = far.join(every, ["frame", "key"]).where("root_a <> root_b").where(f"weight_a + weight_b - slack_a <= {whole} * (least(n_a - place_a, n_b - place_b) + 1)")
    return met.select(F.least("mark_a", "mark_b").alias("a"), F.greatest("mark_a", "mark_b").alias("b")).distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, F.col("mark") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "mark"))


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The buckets of more than one root, with ``root``."""
    rooted = _rooted(shared, roots)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("key")
    return rooted.join(mixed, "key")


def near_duplicates(docs: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``doc_id, component_id`` of every document with an id: the least id linked to it by similar pairs.

    ``candidates(x, y)`` are pairs of ids found another way, which are verified first; whatever they are,
    the result is the same.
    """
    short_batches(docs.sparkSession)
    docs = documents(docs).where("doc_id is not null")
    buckets = buckets_for(docs)
    marks = staged(docs.mapInArrow(tidy(_prefix_batches(frequent_hashes(docs, buckets))), "doc_id long, mark long, size int, prefix binary, sketch binary"), "shingles")
    # Rows of one mark have one set, and so one size and bitmap.
    least = staged(marks.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "shingle-distinct")
    # Of a repeated row one stands for the set; keys are shuffled once and only shared ones are written.
    first = marks.select("doc_id", "mark", "size", "prefix").join(least.select("mark", "doc_id"), ["mark", "doc_id"]).select("mark", "size", "prefix")
    keyed = first.mapInArrow(tidy(_key_batches(buckets)), "bucket int, data binary")
    shared = staged(keyed.groupBy("bucket").applyInArrow(_shared_of, "key long, mark long, size int, place int, n long"), "shingle-buckets")
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    if candidates is not None:
        named = lambda n, mark: marks.select(F.col("doc_id").alias(n), F.col("mark").alias(mark))
        both = candidates.join(named("x", "p"), "x").join(named("y", "q"), "y").where("p <> q")
        pairs = staged(both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "shingle-candidates")
        links = linked(pairs, least, docs)
    roots = connected_components(links)
    open_ = staged(_mixed(shared, roots), "shingle-open")
    stars = staged(_stars(open_.drop("root")), "shingle-stars")
    links = links.union(linked(stars.select(F.least("mark", "hub").alias("a"), F.greatest("mark", "hub").alias("b")).distinct(), least, docs))
    roots = connected_components(links)
    mixed = staged(_mixed(open_.drop("root"), roots), "shingle-mixed")
    frames = stars.where("place = 0").select("mark", F.col("hub").alias("frame")).join(mixed.select("mark").distinct(), "mark")
    # Counted first, since one frame may have most of the marks.
    frames = frames.join(frames.groupBy("frame").agg(F.count("*").alias("members")), "frame")
    framed = likely(frames.where("members > 1").select(F.col("mark").alias("a"), F.col("frame").alias("b")), least, FRAME_SHARE)
    sets = sets_of(_both(framed), least, docs, "shingle-sets")
    apart = differences(framed.select(F.col("a").alias("mark"), F.col("b").alias("frame")), sets)
    known = frames.where("members = 1").select("mark", "frame").union(apart.select("mark", "frame").distinct())
    rest = staged(_pairs(mixed.join(known, "mark", "left")).union(_framed_pairs(apart, roots)), "shingle-rest")
    if not rest.isEmpty():
        links = links.union(linked(rest, least, docs))
        roots = connected_components(links)
    rooted = _rooted(least.select("mark", "doc_id"), roots)
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("mark", "component_id")
    return marks.select("doc_id", "mark").join(named, "mark").select("doc_id", "component_id")
