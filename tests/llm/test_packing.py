import zlib

import numpy as np
import pytest

from skylattice.llm import packing as P
from skylattice.llm import registry


@pytest.fixture(scope="module")
def path():
    return registry.tokenizer_path()


def test_tokens_equal_the_tokenizer(path, texts):
    words = P.WordIds(path)
    hard = ["A <|endoftext|> b", "don't 'S éÉ́  z\x1cq ﬁ", "İx ΑΣ", "a\x00b", "ÀÉÎ ÿŸ ß× a×b¿ñÑ ''s 'll'", "it's 12.5% <|startoftext|>x", " em space"]
    for t in [*(t or "" for t in texts), *hard]:
        assert words.encode(t) == np.array(words.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("seed", range(3))
def test_plan_packs_all_and_few(seed):
    rng = np.random.default_rng(seed)
    length = np.clip((rng.lognormal(5.5, 1.2, 5000)).astype(int), 1, P.CAPACITY)
    count = np.bincount(length, minlength=P.CAPACITY + 1)
    packed, of_program = P.plan(count)
    got = np.zeros_like(count)
    for pattern, times in packed:
        assert sum(s * a for s, a in pattern.items()) <= P.CAPACITY and times > 0
        for s, a in pattern.items():
            got[s] += a * times
    assert (got == count).all()
    n = sum(t for _, t in packed)
    assert of_program > 0.8 * n
    assert n <= -(-int(length.sum()) // P.CAPACITY) * 1.01 + 1 and n <= sum(t for _, t in P.best_fit(count)) + 1


def test_frame(docs, empty, texts, path):
    rows = P.pack(docs, path, 64).toPandas()
    assert len(rows[rows.doc_id == 3]) == 1 and rows[rows.doc_id == 3].iloc[0]["length"] == 1
    place = rows.sort_values(["sequence_id", "offset"])
    assert (place.groupby("sequence_id")["length"].cumsum() - place["length"] == place["offset"]).all()
    assert place.groupby("sequence_id")["length"].sum().max() <= 64
    words = P.WordIds.of(path)
    for i, t in enumerate(texts):
        ids = words.encode(t or "") + P.SEPARATOR
        own = rows[rows.doc_id == i].sort_values("piece").drop_duplicates("piece")
        parts = [ids[k : k + 256] for k in range(0, len(ids), 256)]
        assert own["ids_crc32"].tolist() == [zlib.crc32(p) for p in parts] and own["start"].tolist() == [64 * k for k in range(len(parts))]
    assert P.pack(empty, path).count() == 0
