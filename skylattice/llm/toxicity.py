"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Training reads a bounded sample of labelled documents (``MAX_TOXIC`` and ``MAX_CLEAN`` ids, the
least by a hash, of at most ``MAX_BYTES`` of text).  A token's features are its word, its prefixes,
and the prefixes of the words before and after it; those that occur in two toxic documents or more and
seldom in clean ones enter the model.  No token labels are given, so the field finds them: tokens of
toxic documents with a telling feature of their own start as toxic, all others as clean; the chain of
two states (one weight for each feature, a bias, transitions) is fitted by gradient ascent on the
log-likelihood, its marginals relabel the tokens of toxic documents, and it is fitted again.
Forward-backward marginals then give each token's probability; a logistic model of their largest and
summed values gives the document's score.

Most tokens have no such feature and so one common emission.  The chain over a gap of them is a
power of one 2x2 matrix, so the exact marginals need a step only for each token with features,
whatever the length of the text.

Null ids teach nothing and count as held out.  Null and empty texts have no tokens and get the score of a
document without toxic tokens.  Labels
that are null are ignored; with no usable labels every score is 0.  Repeated rows score alike and
teach once; of several texts under one id the least teaches.  Very long texts are scored by slices of
documents, one long document at a time.  Scores that tie have no order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_texts, documents, hash_words, mix, text_buffer, tidy, word_spans

#: Bounds of the training sample: documents, and bytes of their texts.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 2000, 3000, 48 << 20
#: A feature occurs in at least so many toxic documents; the penalty weighs it, whatever its share.
MIN_DOCS = 2
#: Least logarithm of the ratio of the smoothed shares among toxic and clean documents, of a feature
#: of the model and of one that marks a token as toxic at first.
MIN_LOG_RATIO, TELLING = 3.0, 4.0
#: Fits in all, steps of each, windows of tokens around features and elsewhere in each class, and penalty.
FITS, STEPS, WINDOWS, OTHER_WINDOWS, PENALTY = 2, 80, 4000, 1500, 2e-5
THRESHOLD = 0.7
#: Gaps between lexicon tokens beyond this length behave alike to double precision.
LONG_GAP = 96
#: Text bytes whose tokens are held at once.
SLICE = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and ends of the words, and their feature codes (zero: none)."""
    low = LOWER[raw]
    starts, ends = word_spans(_LETTER[low], offsets)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    length = ends - starts
    key = np.zeros(len(starts), np.uint64)
    for i in range(8):
        key |= np.where(length > i, padded[starts + i], 0).astype(np.uint64) << np.uint64(8 * (7 - i))
    own = [mix(hash_words(low, starts, ends))]
    for n in PREFIXES:
        mask = np.uint64((1 << 64) - (1 << 8 * (8 - n)))
        own.append(np.where(length >= n, mix((key & mask) + np.uint64(n)), np.uint64(0)))
    stem = own[1 + PREFIXES.index(CONTEXT)]
    first = np.searchsorted(starts, offsets)
    before, after = np.zeros_like(stem), np.zeros_like(stem)
    before[1:], after[:-1] = stem[:-1], stem[1:]
    before[first[first < len(stem)]] = 0
    after[first[first > 0] - 1] = 0
    context = [np.where(c > 0, mix(c + np.uint64(k)), np.uint64(0)) for k, c in ((1, before), (2, after))]
    return starts, ends, own + context


#: Bytes of the prefixes of a word, and of those of its neighbours; features that are the token's own.
PREFIXES, CONTEXT = (4, 5, 6), 5
OWN = 1 + len(PREFIXES)
#: Bound of the log-odds that enter a document's score.
_ODDS = 8.0


@dataclass
class Model:
    """Everything a task needs: a few thousand numbers."""

    lexicon: np.ndarray
    weight: np.ndarray
    bias: float
    transition: np.ndarray
    calibration: np.ndarray

    def emissions(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens have a feature of the model, and the score of the toxic state of those."""
        score, active = np.zeros(len(codes[0])), np.zeros(len(codes[0]), bool)
        if len(self.lexicon):
            for code in codes:
                at = np.minimum(np.searchsorted(self.lexicon, code), len(self.lexicon) - 1)
                hit = self.lexicon[at] == code
                score += np.where(hit, self.weight[at], 0.0)
                active |= hit
        index = np.flatnonzero(active)
        return index, score[index] + self.bias

    def gaps(self) -> np.ndarray:
        """Normalised chain matrices over 0 .. LONG_GAP tokens without features, and the closing step."""
        step = np.exp(self.transition) * np.exp([0.0, self.bias])
        out = np.empty((LONG_GAP + 1, 2, 2))
        now = np.eye(2)
        for k in range(LONG_GAP + 1):
            out[k] = now
            now = now @ step
            now /= now.max()
        return out

    def marginals(self, position: np.ndarray, score: np.ndarray, n: int, gaps: np.ndarray) -> np.ndarray:
        """Probabilities of the toxic state at the lexicon tokens of one document of n tokens."""
        m, turn = len(position), np.exp(self.transition)
        before = np.minimum(np.diff(position, prepend=-1) - 1, LONG_GAP)
        forward = np.empty((m, 2))
        emit = np.exp(np.stack([np.zeros(m), np.minimum(score, 300)], 1) - np.maximum(score, 0)[:, None])
        a = None
        for i in range(m):
            if a is None:
                a = emit[i].copy() if before[i] == 0 else np.array([1.0, np.exp(self.bias)]) @ gaps[before[i] - 1] @ turn * emit[i]
            else:
                a = a @ gaps[before[i]] @ turn * emit[i]
            a = a / a.sum()
            forward[i] = a
        backward = np.empty((m, 2))
        b = gaps[min(n - 1 - int(position[-1]), LONG_GAP)] @ np.ones(2)
        for i in range(m - 1, -1, -1):
            backward[i] = b / b.sum()
            if i:
                b = gaps[before[i]] @ turn @ (emit[i] * backward[i])
        both = forward * backward
        return both[:, 1] / both.sum(1)

    def score(self, marginal: np.ndarray) -> float:
        x = self.calibration @ _summary(marginal)
        return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def _summary(marginal: np.ndarray) -> np.ndarray:
    """Of the tokens' marginals: the largest, the log-odds that some token is toxic if they were independent, the sum."""
    if not len(marginal):
        return np.array([1.0, 0.0, -_ODDS, 0.0])
    none = float(np.log1p(-np.minimum(marginal, 1 - 1e-9)).sum())
    odds = np.log(-np.expm1(none) + 1e-12) - none
    return np.array([1.0, float(marginal.max()), np.clip(odds, -_ODDS, _ODDS), np.log1p(float(marginal.sum()))])


def _spread(texts: list[bytes]) -> list[bytes]:
    """The texts without near copies of earlier ones (three-word shingles of least hash)."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = text.split()
        hashes = sorted(zlib.crc32(b" ".join(words[i : i + 3])) for i in range(len(words) - 2))[:4]
        if seen.isdisjoint(hashes):
            out.append(text)
        seen.update(hashes)
    return out


def _arrays(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pa.array(texts, pa.large_binary()))


def _document_counts(texts: list[bytes]) -> list[Counter]:
    """For each kind of feature, in how many of the texts a code occurs."""
    out: list[Counter] = [Counter() for _ in range(OWN + 2)]
    for text in texts:
        for seen, code in zip(out, tokens(*_arrays([text]))[2], strict=True):
            seen.update(np.unique(code[code > 0]).tolist())
    return out


def fit(texts: list[bytes], labels: list[int], rounds: int = STEPS) -> Model:
    """Fit the field on labelled texts (a bounded sample; runs in memory)."""
    every = [t for t, y in zip(texts, labels, strict=True) if y]
    toxic = _spread(every)
    clean = [t for t, y in zip(texts, labels, strict=True) if not y]
    chosen, telling = set(), set()
    for k, (bad, good) in enumerate(zip(_document_counts(toxic), _document_counts(clean), strict=True)):
        for code, n in bad.items():
            ratio = np.log((n + 0.5) / (len(toxic) + 1)) - np.log((good[code] + 0.5) / (len(clean) + 1))
            if n >= MIN_DOCS and ratio >= MIN_LOG_RATIO:
                chosen.add(code)
                if ratio >= TELLING and k < OWN:
                    telling.add(code)
    model = Model(np.array(sorted(chosen), np.uint64), np.zeros(len(chosen)), -3.0, np.zeros((2, 2)), np.array([-5.0, 5.0, 1.0, 0.0]))
    if not telling:
        model.calibration = np.array([-50.0, 0.0, 0.0, 0.0])
        return model
    _train(model, toxic, clean, np.array(sorted(telling), np.uint64), rounds)
    # The field learns from different texts; the scores are calibrated on all of the sample, as often as they occur.
    _calibrate(model, every, clean)
    return model


def _windows(model: Model, texts: list[bytes], telling: np.ndarray, width: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Windows of tokens around features and elsewhere: feature numbers (the last: none) and telling tokens."""
    parts: list[list[np.ndarray]] = [[], []]
    none = len(model.lexicon)
    for at in range(0, len(texts), 256):
        _, _, codes = tokens(*_arrays(texts[at : at + 256]))
        place = [np.minimum(np.searchsorted(model.lexicon, c), none - 1) for c in codes]
        number = np.stack([np.where(model.lexicon[p] == c, p, none) for p, c in zip(place, codes, strict=True)], 1).astype(np.int32)
        n = len(number)
        if n < width:
            continue
        share = min(256, len(texts) - at) / len(texts)
        active = np.flatnonzero((number < none).any(1))
        spots = np.concatenate([rng.permutation(active)[: int(np.ceil(WINDOWS * share))], rng.integers(0, n, int(np.ceil(OTHER_WINDOWS * share)))])
        rows = np.clip(spots - rng.integers(0, width, len(spots)), 0, n - width)[:, None] + np.arange(width)
        parts[0].append(number[rows])
        parts[1].append(np.isin(np.stack(codes[:OWN], 1), telling).any(1)[rows])
    return (np.concatenate(parts[0]), np.concatenate(parts[1])) if parts[0] else None


def _train(model: Model, toxic: list[bytes], clean: list[bytes], telling: np.ndarray, rounds: int, width: int = 17) -> None:
    """Gradient ascent over the windows; between two fits the marginals relabel those of toxic documents."""
    rng = np.random.default_rng(7)
    found = [(_windows(model, group, telling, width, rng), label) for group, label in ((toxic, True), (clean, False))]
    found = [(w, label) for w, label in found if w is not None]
    if not found:
        return
    f = np.concatenate([w[0] for w, _ in found])
    of_toxic = np.repeat([label for _, label in found], [len(w[0]) for w, _ in found])[:, None]
    y = np.concatenate([w[1] for w, _ in found]) & of_toxic
    some = (f < len(model.lexicon)).any(2)
    params = np.zeros(len(model.lexicon) + 1 + 1 + 4)
    params[len(model.lexicon) + 1] = -2.0
    for _ in range(FITS):
        p1 = _ascend(params, f, y.astype(np.int64), rounds)
        y = (p1 >= 0.5) & of_toxic & some
    size = len(model.lexicon) + 1
    model.weight, model.bias, model.transition = params[: size - 1].copy(), float(params[size]), params[size + 1 :].reshape(2, 2).copy()


def _ascend(params: np.ndarray, f: np.ndarray, y: np.ndarray, rounds: int) -> np.ndarray:
    """Changes the parameters (features, none, bias, transitions) by steps of adaptive size; the last marginals."""
    n, width, kinds = f.shape
    size = len(params) - 5
    first, second = np.zeros_like(params), np.zeros_like(params)
    pair_gold = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    emit_gold = np.bincount(f[y == 1].ravel(), minlength=size).astype(float)
    p1 = np.zeros((n, width))
    for step in range(1, rounds + 1):
        weight, bias, turn = params[:size].copy(), params[size], params[size + 1 :].reshape(2, 2)
        weight[-1] = 0
        e = np.clip(weight[f].sum(2) + bias, -30, 30)
        emit = np.stack([np.ones_like(e), np.exp(e)], 2)
        move = np.exp(turn)
        forward, scale = np.empty((n, width, 2)), np.empty((n, width))
        for t in range(width):
            a = emit[:, 0] if t == 0 else (forward[:, t - 1] @ move) * emit[:, t]
            scale[:, t] = a.sum(1)
            forward[:, t] = a / scale[:, t, None]
        back, pair = np.ones((n, 2)), np.zeros((2, 2))
        for t in range(width - 1, -1, -1):
            both = forward[:, t] * back
            p1[:, t] = both[:, 1] / both.sum(1)
            if t:
                right = emit[:, t] * back / scale[:, t, None]
                pair += move * (forward[:, t - 1].T @ right)
                back = right @ move.T
        grad = np.empty_like(params)
        grad[:size] = emit_gold - np.bincount(f.ravel(), np.repeat(p1.ravel(), kinds), size)
        grad[size] = y.sum() - p1.sum()
        grad[size + 1 :] = (pair_gold - pair).ravel()
        grad = grad / n - PENALTY * params
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        params += 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return p1


def _calibrate(model: Model, toxic: list[bytes], clean: list[bytes]) -> None:
    """Logistic regression of the label on the summaries, by Newton steps with a small penalty."""
    x, y = [], []
    for group, label in ((toxic, 1.0), (clean, 0.0)):
        for _, marginal in _documents(model, *_arrays(group)):
            x.append(_summary(marginal))
            y.append(label)
    x, y, w = np.array(x), np.array(y), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
        w += np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * w)
    model.calibration = w


def _documents(model: Model, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each document (byte ranges of its lexicon tokens, their marginals); about SLICE bytes at a time."""
    gaps = model.gaps()
    at, n_docs = 0, len(offsets) - 1
    while at < n_docs:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        own = offsets[at : to + 1] - offsets[at]
        starts, ends, codes = tokens(raw[offsets[at] : offsets[to]], own)
        index, score = model.emissions(codes)
        first = np.searchsorted(starts, own)
        cut = np.searchsorted(index, first)
        for d in range(to - at):
            rows = slice(cut[d], cut[d + 1])
            hit = index[rows]
            if not len(hit):
                yield np.zeros((0, 2), np.int64), np.zeros(0)
                continue
            p = model.marginals(hit - first[d], score[rows], int(first[d + 1] - first[d]), gaps)
            yield np.stack([starts[hit], ends[hit]], 1) - own[d], p
        at = to


def sample(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> tuple[list[bytes], list[int]]:
    """At most MAX_TOXIC and MAX_CLEAN labelled texts of MAX_BYTES in all, the least by a hash of the id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    if usable is not None:
        marks = marks.where(usable)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = []
    for label, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked += [(r["doc_id"], r["toxic"]) for r in part.collect()]
    toxic = dict(picked)
    texts = bounded_texts(docs, list(toxic), MAX_BYTES)
    return [t.encode() for _, t in texts], [toxic[i] for i, _ in texts]


def _score_batches(model: Model, spans: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            scores, lists = [], []
            for d, (where, p) in enumerate(_documents(model, raw, offsets)):
                scores.append(model.score(p))
                found = []
                if spans and len(p):
                    place = np.cumsum((raw[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)
                    found = [{"start": int(place[a] - 1), "end": int(place[b - 1]), "p": float(q)} for (a, b), q in zip(where, p, strict=True) if q >= 0.5]
                lists.append(found)
            arrays = [batch.column("doc_id"), pa.array(scores, pa.float64())]
            names = ["doc_id", "score"]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                arrays.append(pa.array(lists, kind))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """``doc_id, score`` and, if asked, ``spans``: code-point offsets of toxic words and their marginals."""
    schema = "doc_id long, score double" + ", spans array<struct<start:int,end:int,p:double>>" * spans
    return documents(docs).mapInArrow(tidy(_score_batches(model, spans)), schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text").fill_null(""))
            yield batch.filter(pa.array([model.score(p) < threshold for _, p in _documents(model, raw, offsets)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    return fit(*sample(docs, labels, usable))


def in_training(modulus: int = 3, held_out: int = 1) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus != held_out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that never sees a label of the held-out third."""
    model = train(docs, labels, in_training())
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(~in_training(), F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
