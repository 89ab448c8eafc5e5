"""Rounds, filters and hashes of the shingle join."""

import random

import numpy as np
import plain
import pytest
from test_contracts import frame, rows

from lexiloom.llm import fsjoin


def test_shingle_join_keeps_each_text_of_a_repeated_id(spark):
    a, b, c = (plain.prose(random.Random(i), 60) for i in (1, 2, 3))
    docs = [(1, a), (1, b), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (4, a + " end"), (5, None), (5, ""), (None, a), (None, a)]
    kept = fsjoin.keep_one(frame(spark, docs)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (1, b), (4, c), (5, ""), (5, ""), (0, a), (0, a)])


@pytest.mark.parametrize("n", [2048, 100_000])
def test_words_of_regular_build_have_their_own_hash(n):
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    both = f"{word} {other} {word}".encode()
    h, _ = fsjoin.Shingler().words(np.frombuffer(both, np.uint8), np.array([0, len(both)]))
    assert h[0] == h[2] != h[1]
    assert len(set(fsjoin.Shingler().words(np.frombuffer(b"Ab aB abc", np.uint8), np.array([0, 9]))[0].tolist())) == 2


def test_shingle_join_of_a_large_group(spark, monkeypatch):
    """Many near copies, some too far from most others, in long lists that are dealt to several tasks."""
    monkeypatch.setattr(fsjoin, "LIST_ROWS", 40)
    rnd = random.Random(5)
    base = plain.prose(rnd, 150).split(" ")
    docs = []
    for i in range(260):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4, 6, 7])):
            w[rnd.randrange(len(w))] = plain.prose(rnd, 1)
        docs.append((i, " ".join(w)))
    docs += [(i, plain.prose(rnd, 12) + " " + " ".join(base[:60])) for i in range(300, 380)]
    got, want = rows(fsjoin.join(frame(spark, docs))), plain.components(docs)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_parities_never_exceed_the_differences():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (40, 53), (31, 33), (900, 700), (64, 64)):
        both = rng.integers(0, 2**63, min(n, m), dtype=np.uint64)
        for common_part in (0, len(both) // 2, len(both)):
            x = np.concatenate([both[:common_part], rng.integers(0, 2**63, n - common_part, dtype=np.uint64)])
            y = np.concatenate([both[:common_part], rng.integers(0, 2**63, m - common_part, dtype=np.uint64)])
            bits = fsjoin.parities(np.repeat([0, 2], [n, m]), np.concatenate([x, y]), np.array([n, 0, m])).to_pylist()
            far = fsjoin.differences(bits[0], bits[2])
            true = n + m - 2 * common_part
            assert far <= true and far >= 0.4 * true - 4
