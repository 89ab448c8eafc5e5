"""The landing of the cube method: sources with a few very long documents, and probabilities at the edges."""

import math
import random

import pytest
from test_contracts import frame

from lexiloom.llm import mixing


@pytest.mark.parametrize(("block", "share"), [(8192, 0.01), (32, 0.03)])  # blocks of 32 leave four documents to land on
def test_long_documents_come_near_the_target(spark, block, share, monkeypatch):
    monkeypatch.setattr(mixing.decide, "__defaults__", ((1, 2, 3), 3.0, 7, block))
    rnd = random.Random(11)
    docs = [(i, "w " * round(math.exp(rnd.uniform(0, math.log(20_000))))) for i in range(360)] + [(i, "w") for i in range(400, 420)]
    df = frame(spark, docs, lambda i: f"s{(i or 0) % 6}")
    taken, target = {}, {}
    for r in mixing.digest(df).collect():
        s = f"s{r.doc_id % 6}"
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= share * target[s] for s in target), (taken, target)


def test_probabilities_at_the_edges():
    rng = random.Random(1)
    prob = [2.3e-16] * 40 + [1 - 2.3e-16] * 40
    end = mixing.flight(prob, [5] * 80, rng)
    assert end == [0.0] * 40 + [1.0] * 40 == mixing.landing(prob, end, [5] * 80, rng)
    for _ in range(200):
        size = [rng.choice([0, 1, 3, 50, 20_000]) for _ in range(rng.randint(1, 12))]
        prob = [rng.random() for _ in size]
        end = mixing.landing(prob, mixing.flight(prob, size, rng), size, rng)
        assert set(end) <= {0.0, 1.0}


def test_inclusion_probabilities_are_kept():
    size = [1 + i % 17 for i in range(60)]
    rng = random.Random(2)
    total = [0.0] * 60
    for _ in range(3000):
        prob = [0.3] * 60
        for i, x in enumerate(mixing.landing(prob, mixing.flight(prob, size, rng), size, rng)):
            total[i] += x
    assert all(abs(t / 3000 - 0.3) < 0.08 for t in total)
