"""Near-duplicate vectors with repeats, several lengths, clashing columns, and groups over several blocks."""

import numpy as np
import plain
import pytest

from lexiloom.llm import capfilter


@pytest.mark.parametrize("kind", ["float", "double"])
def test_repeats_lengths_and_clashing_columns(spark, monkeypatch, kind):
    monkeypatch.setattr(capfilter, "BLOCK", 8)
    monkeypatch.setattr(capfilter, "BATCH_ROWS", 500)
    rng = np.random.default_rng(6)
    width = np.float32 if kind == "float" else np.float64
    x = [rng.standard_normal(64) for _ in range(30)]
    x += [x[0] + rng.standard_normal(64) * 0.02 for _ in range(60)]  # one large group
    x += [x[1].copy() for _ in range(10)] + [rng.standard_normal(9) for _ in range(5)] + [np.ones(9) * k for k in (1, 2, 3)] + [np.array([1.0]), np.array([2.0]), np.array([-1.0])]
    x = [v.astype(width) for v in x]
    rows = [(i, v.tolist(), 1 if i % 10 else 2, i, "b", 1) for i, v in enumerate(x)]
    rows += [(i, None, 1, i, "b", 1) for i in (500, 501)] + [(502, [float("inf")] + [0.0] * 63, 1, 1, "b", 1), (None, x[0].tolist(), 1, 1, "b", 1)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, rep long, `filter` string, weight int").repartition(3)
    got = {r.vec_id: r for r in capfilter.near_duplicates(df).collect()}
    links = []
    for i, a in enumerate(x):
        for j in range(i):
            if len(a) == len(x[j]) and (i % 10 == 0) == (j % 10 == 0):
                p, q = a.astype(float), x[j].astype(float)
                if p @ q / np.sqrt(p @ p) / np.sqrt(q @ q) >= 0.98:
                    links.append((j, i))
    root = plain.roots(len(x), links)
    count = np.bincount(np.array(links).ravel(), minlength=len(x))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (count[i], root[i], root[i] == i) for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (500, 501, 502))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False) and len(got) == len(rows)
