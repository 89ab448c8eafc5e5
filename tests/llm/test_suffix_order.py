"""The order of suffixes, splitters inside a suffix, and long texts, against plain versions."""

import random

import numpy as np
import plain
import pytest
from test_contracts import frame, rows

from lexiloom.llm import suffixes


def test_leading_words_have_the_order_of_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 4, 5000).astype(np.uint8) * 85
    at = rng.integers(0, 5000 - suffixes.GRAM, 1500)
    order = suffixes.multikey_order(*suffixes.leading(data, at))
    some = [data[p : p + suffixes.GRAM].tobytes() for p in at[order]]
    assert some == sorted(some)


def test_splitters_stand_before_equal_keys():
    rng = np.random.default_rng(2)
    for size in (0, 1, 400):
        keys = rng.integers(0, 4, (4, size)).astype(np.uint64)
        keys = list(keys[:, np.lexsort(keys[::-1])])
        points = rng.integers(0, 4, (4, 60)).astype(np.uint64)
        points = list(points[:, np.lexsort(points[::-1])])
        have = list(zip(*(k.tolist() for k in keys), strict=True))
        want = [sum(h < p for h in have) for p in zip(*(x.tolist() for x in points), strict=True)]
        assert suffixes.places(points, keys).tolist() == want


def test_sent_units_come_back():
    rng = np.random.default_rng(3)
    s0, s1 = (rng.integers(0, 2**63, 50, dtype=np.uint64) for _ in range(2))
    s2, unit = rng.integers(0, 2**32, 50, dtype=np.uint64) << np.uint64(32), rng.integers(0, 2**48, 50, dtype=np.uint64)
    doc, several = rng.integers(0, 99, 50), rng.integers(0, 2, 50).astype(np.uint8)
    back = suffixes.received(suffixes.sent([s0, s1, s2, unit], doc, several))
    assert all((x == y).all() for x, y in zip(back, (s0, s1, s2, unit, doc, several), strict=True))


@pytest.mark.parametrize("rows_of_a_range", [150, 600_000])
def test_a_suffix_with_many_continuations(spark, monkeypatch, rows_of_a_range):
    """One passage before very many different texts, so that splitters fall inside its suffixes."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", rows_of_a_range)
    rnd = random.Random(7)
    passage = "the same forty-odd bytes stand before each text "
    docs = [(i, plain.prose(rnd, rnd.randint(0, 6)) + passage * rnd.randint(1, 2) + plain.prose(rnd, rnd.randint(0, 6))) for i in range(900)]
    docs += [(i, "ab" * rnd.randint(30, 400) + "  " * 60) for i in range(900, 940)]
    got, want = rows(suffixes.remove_repeats(frame(spark, docs))), plain.removed(docs)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


def test_texts_over_several_strides(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "STRIDE", 700)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 20_000)
    rnd = random.Random(9)
    long = plain.prose(rnd, 2500)
    docs = [(3, long), (1, long[4000:9000] + plain.prose(rnd, 100)), (2, plain.prose(rnd, 900) + long[100:400]), (4, "z" * 5000), (5, None), (6, "z" * 60)]
    out = suffixes.remove_repeats(frame(spark, docs))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()} == plain.removed(docs)
