"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams (two to four bytes of lower-cased
letters, runs of anything else count as one space).  Embeddings and classifier are trained in numpy
by stochastic gradient descent on the lines of a bounded sample (``MAX_DOCUMENTS`` documents of at most
``MAX_BYTES``, spread over the languages so that a rare one is learned too); averaging commutes with
the linear layer, so scoring needs one table row for each n-gram.  A temperature and a rejection
level are calibrated on every fifth document of the sample, which the descent doesn't see.

Null texts and texts without a letter get ``und`` and score 0.  Rows of null language teach nothing;
without any usable row everything is ``und``.  Repeated rows get equal predictions and teach once (of
several texts under one id the least teaches, as its first language by name).  Very long texts are
scored by slices of documents, a long document at a time.  Of languages with equal scores the first by
name wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, bounded_texts, text_buffer

#: Bounds of the training sample: documents (the least by a hash of the id in each language), bytes of
#: their texts, lines, and documents of a language at least (so the languages are bounded too, the most frequent first).
MAX_DOCUMENTS, MAX_BYTES, MAX_LINES, LEAST_EACH = 4000, 48 << 20, 12_000, 20
BUCKETS, DIMENSIONS = 1 << 15, 16
EPOCHS, RATE, BATCH = 3, 0.8, 128
#: Share of calibration documents whose confidence lies below the rejection level.
REJECTED_SHARE = 0.005
#: Text bytes that are scored at once.
SLICE = 2 << 20

_CLASS = np.full(256, ord(" "), np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, grouped by row, and the bounds of the rows."""
    n_rows = len(offsets) - 1
    letters = _CLASS[LOWER[raw]]
    # A space on both sides of each row, and runs of spaces made one.
    padded = np.full(len(raw) + 2 * n_rows, ord(" "), np.uint8)
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    padded[np.arange(len(raw)) + 2 * row + 1] = letters
    bound = offsets + 2 * np.arange(n_rows + 1)
    space = padded == ord(" ")
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[bound[:-1]] = True
    text = padded[keep].astype(np.uint32)
    size = np.add.reduceat(keep, bound[:-1]).astype(np.int64) if n_rows else np.zeros(0, np.int64)
    bound = np.concatenate([[0], np.cumsum(size)])
    end = np.repeat(bound[1:], size)
    place = np.arange(len(text))
    parts, owners = [], []
    code = text.copy()
    for n in (2, 3, 4):
        code = code[:-1] * np.uint32(0x01000193) ^ text[n - 1 :] if len(text) >= n else np.zeros(0, np.uint32)
        m = len(code)
        inside = np.flatnonzero(place[:m] + n <= end[:m])
        parts.append(((code[inside] * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(17))
        owners.append(np.searchsorted(inside, bound))
    joined = np.concatenate([np.concatenate([p[o[i] : o[i + 1]] for p, o in zip(parts, owners, strict=True)]) for i in range(n_rows)]) if n_rows else np.zeros(0, np.uint32)
    return joined.astype(np.int64), np.concatenate([[0], np.cumsum(sum(np.diff(o) for o in owners))]) if n_rows else np.zeros(1, np.int64)


def _means(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Row means of grouped values; zero for empty groups."""
    n = np.diff(bound)
    out = np.zeros((len(n), values.shape[1]), np.float64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(values, bound[:-1][full], axis=0) / n[full, None]
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        at, n_rows = 0, len(offsets) - 1
        while at < n_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            bucket, bound = grams(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            out.append(_means(self.table[bucket], bound))
            at = to
        x = np.concatenate(out) * self.temperature
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """Train on labelled texts (a bounded sample; runs in memory)."""
    names = sorted(set(languages))
    if not names:
        return None
    code = {name: i for i, name in enumerate(names)}
    rng = np.random.default_rng(11)
    lines: list[str] = []
    label: list[int] = []
    held: list[int] = []
    for i, (text, language) in enumerate(zip(texts, languages, strict=True)):
        if i % 5 == 4:
            held.append(i)
            continue
        for line in text.split("\n"):
            if any(c.isalpha() for c in line):
                lines.append(line)
                label.append(code[language])
    order = rng.permutation(len(lines))[:MAX_LINES]
    n_class = len(names)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight = np.zeros((DIMENSIONS, n_class), np.float32)
    weight += rng.normal(0, 0.1, weight.shape)
    y = np.array(label)
    steps, step = max(1, EPOCHS * len(order) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(order)
        for at in range(0, len(order), BATCH):
            rate = RATE * max(0.05, 1 - step / steps)
            step += 1
            chosen = order[at : at + BATCH]
            raw, offsets = text_buffer(pa.array([lines[i] for i in chosen], pa.large_string()))
            bucket, bound = grams(raw, offsets)
            x = _means(embed[bucket], bound)
            z = x @ weight
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1
            toward = p @ weight.T
            weight -= (rate / len(chosen)) * (x.T @ p)
            n = np.maximum(np.diff(bound), 1)
            slope = np.repeat(toward / n[:, None], np.diff(bound), axis=0)
            for k in range(DIMENSIONS):
                embed[:, k] -= rate * np.bincount(bucket, slope[:, k], BUCKETS).astype(np.float32)
    model = Model(names, (embed @ weight).astype(np.float32), 1.0, 0.0)
    if held:
        raw, offsets = text_buffer(pa.array([texts[i] for i in held], pa.large_string()))
        y = np.array([code[languages[i]] for i in held])
        loss = {}
        for t in np.geomspace(0.25, 16, 13):
            model.temperature = float(t)
            p = model.probabilities(raw, offsets)
            loss[float(t)] = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = min(loss, key=loss.get)
        model.reject_below = float(np.quantile(model.probabilities(raw, offsets).max(1), REJECTED_SHARE))
    return model


def sample(docs: DataFrame, usable: Column) -> tuple[list[str], list[str]]:
    """At most MAX_DOCUMENTS texts of MAX_BYTES in all with their languages: an equal share of each, the least by a hash of the id."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    known = known.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = known.select("doc_id", "lang").distinct()
    languages = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_DOCUMENTS // LEAST_EACH).collect()
    if not languages:
        return [], []
    # What rare languages leave of their equal shares goes to the others.
    quota, reach, room = {}, {}, MAX_DOCUMENTS
    for k, row in enumerate(sorted(languages, key=lambda r: (r["count"], r["lang"]))):
        most = quota[row["lang"]] = min(row["count"], room // (len(languages) - k))
        room -= most
        # Hashes below this hold the least ones, and few more: the ranks below are over a bounded set.
        reach[row["lang"]] = int(min(1.0, (most + 6 * most**0.5 + 10) / row["count"]) * (1 << 31))
    by_language = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[F.col("lang")]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    near = ids.where(place < by_language(reach))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= by_language(quota))
    language: dict[int, str] = {}
    for row in chosen.orderBy("doc_id", F.desc("lang")).select("doc_id", "lang").collect():
        language[row["doc_id"]] = row["lang"]
    texts = bounded_texts(docs.where(F.col("text").isNotNull()), list(language), MAX_BYTES)
    return [t for _, t in texts], [language[i] for i, _ in texts]


def in_training(modulus: int = 4, held_out: int = 2) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus != held_out


def _batches(model: Model | None) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            name, score, rejected = ["und"] * n, [0.0] * n, [True] * n
            if model is not None and n:
                p = model.probabilities(*text_buffer(batch.column("text")))
                best = p.argmax(1)
                some = batch.column("lettered").to_pylist()
                name = [model.languages[k] if ok else "und" for k, ok in zip(best.tolist(), some, strict=True)]
                score = [v if ok else 0.0 for v, ok in zip(p.max(1).tolist(), some, strict=True)]
                rejected = [not ok or v < model.reject_below for v, ok in zip(score, some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, rejected``: rejected marks scores below the calibrated level."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("lettered"))
    return rows.mapInArrow(_batches(model), "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Predictions of all documents by a model that never sees the held-out quarter."""
    model = fit(*sample(docs, in_training()))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(~in_training(), F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")
