"""The search with ties, repeated ids, clashing columns, several lengths and several cells."""

import numpy as np
import pytest

from lexiloom.llm import onebit


@pytest.mark.parametrize("kind", ["float", "double"])
def test_ties_repeats_and_lengths(spark, monkeypatch, kind):
    monkeypatch.setattr(onebit, "ROWS", 90)
    monkeypatch.setattr(onebit, "QUERIES", 7)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (400, 8)).astype(float)  # many equal products
    x[np.abs(x).sum(1) == 0] = 1
    rows = [(i, v.tolist(), 1, "q", 0.5) for i, v in enumerate(x)] + [(20, x[3].tolist(), 1, "q", 0.5), (None, x[0].tolist(), 1, "q", 0.5), (700, [1.0, 2.0], 1, "q", 0.5), (720, [1e300 if kind == "double" else 1e30] * 8, 1, "q", 0.5), (740, [3.0, 1.0], 1, "q", 0.5), (760, [], 1, "q", 0.5)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rank int, block string, score double").repartition(3)
    got = {}
    for r in onebit.search(df, df.where("vec_id % 20 = 0").dropDuplicates(["vec_id"])).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    width = np.float32 if kind == "float" else np.float64
    kept = [(i, np.array(v, width).astype(float)) for i, v, *_ in rows if i is not None and v]
    for q, v in {i: v for i, v in kept if i % 20 == 0 and i != 20}.items():
        with np.errstate(over="ignore"):
            want = sorted(((-float((w * v).sum()), i) for i, w in kept if i != q and len(w) == len(v)))[:20]
        have = sorted(got.get(q, []))
        assert [r for r, _, _ in have] == list(range(1, len(want) + 1))
        assert [(i, s) for _, i, s in have] == [(i, -s) for s, i in want], q
    assert 20 not in {i for _, i, _ in got[20]}


def test_codes_estimate_within_their_error():
    rng = np.random.default_rng(2)
    x, turn = rng.standard_normal((5000, 64)) * rng.uniform(0.1, 9, (5000, 1)), onebit.rotation(64)
    codes = onebit.Codes(*onebit.encoded(x, turn), turn)
    outside = 0
    for q in rng.standard_normal((20, 64)):
        estimate, error = codes.estimate(q)
        outside += int((np.abs(estimate - x @ q) > error).sum())
    assert outside <= 0.002 * 20 * 5000
