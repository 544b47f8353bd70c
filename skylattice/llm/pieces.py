"""Texts cut into the pieces of a byte-level tokenizer's pattern, and pieces numbered within a worker.

The pattern (contractions; letters, numbers or other characters with one space before them; white
space) is followed by array operations on runs of equal character class, so a slice of texts costs a
few passes over its bytes.  Classes of the characters beyond ASCII are those of the installed
library: each is asked once, the first time it is seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import hash_words, text_buffer

OTHER, LETTER, NUMBER, SPACE, UNSEEN = range(5)
_ASCII = np.full(256, OTHER, np.uint8)
_ASCII[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
_ASCII[ord("0") : ord("9") + 1] = NUMBER
_ASCII[[0x20, *range(0x09, 0x0E)]] = SPACE
_WIDTH = np.ones(256, np.int64)
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 2, 3, 4


class Classes:
    """Classes of code points; unseen ones are probed: after a letter, only a letter stays in its piece."""

    _one: Classes | None = None

    def __init__(self, pattern: str) -> None:
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        self.table = np.full(0x110000, UNSEEN, np.uint8)
        self.table[:128] = _ASCII[:128]
        self.probes = []
        for kind, first in ((LETTER, b"a"), (NUMBER, b"1"), (OTHER, b"!")):
            joined = {first + bytes([i]): 256 + i for i in range(256)}
            self.probes.append((kind, first.decode(), tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single | joined, special_tokens={})))

    @classmethod
    def of(cls) -> Classes:
        if cls._one is None:
            import public_tokenizers

            cls._one = cls(public_tokenizers.PATTERN)
        return cls._one

    def of_points(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found == UNSEEN).any():
            for c in np.unique(points[found == UNSEEN]).tolist():
                self.table[c] = next((kind for kind, first, e in self.probes if e.encode_ordinary(first + chr(c))[0] >= 256), SPACE)
            found = self.table[points]
        return found


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of valid UTF-8 belongs to."""
    out = _ASCII[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        width = _WIDTH[raw[lead]]
        points = raw[lead].astype(np.int64) & (0x7F >> width)
        for k in (1, 2, 3):
            more = width > k
            points[more] = points[more] << 6 | raw[lead[more] + k] & 0x3F
        kinds = Classes.of().of_points(points)
        out[lead] = kinds
        for k in (1, 2, 3):
            more = width > k
            out[lead[more] + k] = kinds[more]
    return out


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the bytes at which a piece of the pattern starts; ``offsets`` bound the texts."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, bool)
    kind = byte_classes(raw)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    at = np.flatnonzero(run)
    end = np.append(at[1:], n)
    blank = kind[at] == SPACE
    # The last character of white space stands apart, or goes with what follows if it is a space.
    s = end[blank & ~first[end]]
    last = s - 1
    for _ in range(3):
        last = last - ((raw[last] & 0xC0) == 0x80)
    start[last] = True
    spaced = at[~blank & ~first[at]]
    spaced = spaced[raw[spaced - 1] == 0x20]
    start[spaced] = False
    # Contractions: an apostrophe that starts a piece, and small letters after it in the same text.
    mark = np.flatnonzero((raw == 0x27) & start)
    text_end = offsets[np.searchsorted(offsets, mark, "right")]
    mark, text_end = mark[mark + 1 < text_end], text_end[mark + 1 < text_end]
    one = raw[mark + 1]
    two = np.where(mark + 2 < text_end, raw[np.minimum(mark + 2, n - 1)], 0)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    length = np.where(short, 1, np.where(pair, 2, 0))
    mark, text_end, length = mark[length > 0], text_end[length > 0], length[length > 0]
    start[mark + 1] = False
    rest = (mark + 1 + length)[mark + 1 + length < text_end]
    start[rest[kind[rest] == LETTER]] = True
    return start


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a text column in slices of so many bytes (a longer text has its own), with bytes and offsets."""
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, to - at), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Numbered:
    """Distinct pieces with numbers, by 64-bit hashes; ``learn`` gets each new one once.

    When more than ``most`` are known the table starts anew (``forget`` is called), so it stays bounded.
    """

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], most: int) -> None:
        self.learn, self.forget, self.most = learn, forget, most
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found, first, back = np.unique(hash_words(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > self.most:
            self.forget()
            self.hashes, self.numbers = self.hashes[:0], self.numbers[:0]
        at = np.searchsorted(self.hashes, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == found[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            data = raw.tobytes()
            self.learn([data[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            numbers = len(self.hashes) + np.arange(len(new))
            self.hashes = np.insert(self.hashes, at[new], found[new])
            self.numbers = np.insert(self.numbers, at[new], numbers)
            at = np.searchsorted(self.hashes, found)
        return self.numbers[at][back]


class Lists:
    """Lists of numbers by index, in one flat array that grows."""

    def __init__(self, dtype: type) -> None:
        self.flat, self.starts = np.zeros(0, dtype), np.zeros(1, np.int64)

    def add(self, lists: list[np.ndarray]) -> None:
        self.flat = np.concatenate([self.flat, *lists]) if lists else self.flat
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in lists])]).astype(np.int64)

    def sizes(self, index: np.ndarray) -> np.ndarray:
        return self.starts[index + 1] - self.starts[index]

    def gather(self, index: np.ndarray) -> np.ndarray:
        """The lists of the indices, joined."""
        return self.flat[spread(self.starts[index], self.sizes(index))]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges that begin at the starts, joined."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
