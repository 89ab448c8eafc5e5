"""The Viterbi search against every path of its lattice, and the shortcuts against the search."""

import itertools
import random

import numpy as np
import plain
import pytest
from test_contracts import frame, rows

from lexiloom.llm import toxicity


@pytest.fixture(scope="module")
def restore():
    text = (plain.prose(random.Random(1), 3000) + " stupid moron clown loser" * 20).encode()
    c = toxicity.byte_classes()[np.frombuffer(text, np.uint8)].astype(int)
    n = np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3)
    return toxicity.Restorer(toxicity.language_model(enumerate(n)))


def exhaustive(restore, word):
    best = None
    for path in itertools.product(*restore.lattice(word)):
        symbols = [toxicity.EDGE, toxicity.EDGE, *(k for _, _, ks in path for k in ks), toxicity.EDGE]
        score = sum(float(restore.model[a, b, c]) for a, b, c in zip(symbols, symbols[1:], symbols[2:])) - sum(cost for _, cost, _ in path)
        if best is None or score > best[0]:
            best = (score, "".join(out for out, _, _ in path))
    return best


def test_best_path_of_all(restore):
    rnd = random.Random(2)
    for _ in range(400):
        word = "".join(rnd.choice("abdest1034$@!|-.oo") for _ in range(rnd.randint(1, 7)))
        score, text = restore.best(word)
        want, other = exhaustive(restore, word)
        assert abs(score - want) < 1e-4 and (text == other or abs(score - want) < 1e-9)


def test_doubled_letters_as_the_search(restore):
    rnd = random.Random(3)
    seen = 0
    for _ in range(4000):
        word = "".join(rnd.choice("abdestoué") * rnd.choice([1, 1, 1, 2, 3, 5]) for _ in range(rnd.randint(1, 8)))
        if toxicity.RUN.search(word) and not toxicity.NEIGHBOURS.search(word):
            assert restore.doubled(word) == restore.best(word)[1]
            seen += 1
    assert seen > 500


def test_long_texts_repeats_and_ties(spark):
    bad = "mubbish zorkle"
    docs = [(i, f"{plain.prose(random.Random(i), 20)} {bad if i % 3 == 0 else ''}") for i in range(300)]
    docs += [(300, "q" * 300_000), (301, "a1" * 100_000 + " " + bad), (302, "x " * 100_000), (302, "x " * 100_000), (None, bad)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(frame(spark, docs), labels).collect()
    assert len(got) == len(docs)
    same = [r for r in got if r.doc_id == 302]
    assert same[0] == same[1] and same[0].predicted == 0
    assert [r.predicted for r in got if r.doc_id in (301, None)] == [1, 1] and [r.held_out for r in got if r.doc_id is None] == [False]
    none = rows(toxicity.digest(frame(spark, docs[:40]), labels.limit(0)))
    assert len({r["score"] for r in none.values()}) == 1  # without labels all texts score alike
