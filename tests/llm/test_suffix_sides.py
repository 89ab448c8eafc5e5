"""Windows are sent only where another unit shares a side of the anchor, and no repeat is lost by it."""

import random

import numpy as np
import plain
from test_contracts import frame, rows

from lexiloom.llm import suffixes


def letters(rnd, n):
    return "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def test_chance_neighbours_send_few_windows(spark, monkeypatch):
    """One phrase of 30 bytes between texts that have nothing in common: no window repeats, so hardly one is sent."""
    sent, merged = [], suffixes.merged_windows

    def counted(found):
        sent.extend(len(suffixes.unpacked(r.payload, np.uint64, np.int64)[0]) for r in found.collect())
        return merged(found)

    monkeypatch.setattr(suffixes, "merged_windows", counted)
    rnd = random.Random(5)
    docs = [(i, letters(rnd, 60) + "a phrase that many texts share" + letters(rnd, 60)) for i in range(300)]
    got = rows(suffixes.remove_repeats(frame(spark, docs)))
    assert {i: r["n_removed"] for i, r in got.items()} == {i: 0 for i, _ in docs}
    assert sum(sent) < 300


def test_repeats_of_any_length_beside_other_texts(spark, monkeypatch):
    """Copies of 45 to 90 bytes, so that equal windows stand at every place before and behind their anchors."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 300)
    rnd = random.Random(6)
    source = letters(rnd, 400)
    docs = []
    for i in range(600):
        at, n = rnd.randint(0, 300), rnd.randint(45, 90)
        docs.append((i, letters(rnd, rnd.randint(0, 40)) + source[at : at + n] + letters(rnd, rnd.randint(0, 40))))
    rnd.shuffle(docs)
    got, want = rows(suffixes.remove_repeats(frame(spark, docs))), plain.removed(docs)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
