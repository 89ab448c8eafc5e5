"""Toxicity scores of texts, after noisy-channel restoration of disguised words.

A disguised word (digits or signs for letters, letters set apart, letters repeated) is seen as the
output of a noisy channel. A lattice holds the letters that each observed sign may stand for, and each
space as a word end or as one that the channel put in; a Viterbi search picks the likeliest path under a
character trigram model, counted over all documents. Two letters fix the model's state, so the search
falls into parts at words of two letters or more: these are restored alone, a space between two of them
is decided by the letters beside it, and pieces of fewer letters are searched together with their spaces.
Trigrams cannot tell every end inside such a run, so readings add to each other and none takes a word
away: a word of two letters or more counts by itself too where it is joined, and a run of three single
signs or more counts as one word too.
The restored text is scored by a logistic model over its words and word beginnings; weights are
learned from a bounded sample of labelled documents (MAX_TRAIN), never from held-out ones.

Defined results: null and empty texts get the score of a text without known words; a null doc_id is
not labelled; of repeated labels for one document the larger counts; repeated rows repeat.
"""

from __future__ import annotations

import collections
import functools
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import common

MAX_TRAIN, MAX_FEATURES, THRESHOLD = 8_000, 1500, 0.3
#: Toxic documents that a feature needs.
LEAST_TOXIC = 4
SCORE = "__score"
EDGE, FOREIGN, SYMBOLS = 26, 27, 28
BEGINNINGS = (4, 6, 8)
#: The letters that a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SWAP_COST, DROP_SIGN, DROP_LETTERLIKE, DROP_DIGIT, DROP_SPACE = 1.0, 0.5, 4.0, 7.0, 3.0
#: Between two single signs a space is more likely put in than a word end.
DROP_AMONG_SIGNS, END_AMONG_SIGNS = 0.1, 1.5
DIGIT = math.log(10)  # the cost of a run of one digit in a number
RUN = re.compile(r"(\w)\1")
REPEATED, NEIGHBOURS = re.compile(r"(\w)\1+"), re.compile(r"(\w)\1+(\w)\2+")
#: The cost of another number of letters than the run has.
SECOND_CHOICE = 0.5
LEADING = re.compile(r"^[^\w@$!|(€+]+")
TRAILING = re.compile(r"\W+$")


def byte_classes() -> np.ndarray:
    out = np.full(256, EDGE, np.uint8)
    for i in range(26):
        out[97 + i] = out[65 + i] = i
    out[128:] = FOREIGN
    return out


def trigram_counts(df: DataFrame) -> DataFrame:
    """Rows (cell, n): character trigrams of all texts, at most SYMBOLS^3 rows."""

    def run(batches):
        classes, total = byte_classes(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text"):
                data, off = common.text_buffer(part.column("text"))
                joined = np.full(len(data) + 2 * part.num_rows + 2, EDGE, np.int32)
                joined[np.arange(len(data)) + 2 * np.repeat(np.arange(1, part.num_rows + 1), np.diff(off))] = classes[data]
                total += np.bincount((joined[:-2] * SYMBOLS + joined[1:-1]) * SYMBOLS + joined[2:], minlength=SYMBOLS**3)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell], pa.int64())], ["cell", "n"])

    return df.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def language_model(rows) -> np.ndarray:
    """log P(c | a, b), trigrams backed off to bigrams and letters."""
    tri = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS))
    for cell, n in rows:
        tri.flat[cell] = n
    one = tri.sum((0, 1)) + 1
    one /= one.sum()
    two = tri.sum(0)
    two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    return np.log((tri + 5 * two[None]) / (tri.sum(2, keepdims=True) + 5)).astype(np.float32)


def symbol(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else FOREIGN if c.isalpha() else EDGE


def arc(out: str, cost: float) -> tuple[str, float, list[int]]:
    return out, cost, [symbol(c) for c in out]


@functools.lru_cache(100_000)
def arcs_of(c: str, n: int) -> list[tuple[str, float, list[int]]]:
    """What n of the sign c (3: three or more) may stand for."""
    reads = [(c, 0.0)] if c.isalpha() else [(x, SWAP_COST) for x in STANDS_FOR.get(c, "")]
    arcs = [arc(x * k, cost * k + (0.0 if n == k else SECOND_CHOICE)) for x, cost in reads for k in ((1, 2) if n > 1 else (1,))]
    if not c.isalpha():
        arcs.append(arc("", DROP_DIGIT if c.isalnum() else DROP_LETTERLIKE if c in STANDS_FOR else DROP_SIGN))
    return arcs


class Kept(dict):
    """Results by key, within a bound."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(self) > self.bound:
            self.clear()
        self[key] = got = self.make(key)
        return got


class Restorer(Kept):
    """Restores words and the spaces between them; keeps the results of distinct ones within a bound."""

    def __init__(self, model: np.ndarray):
        super().__init__(self._restore, 500_000)
        self.model, self.table = model, model.ravel().tolist()
        self.ends, self.gaps, self.chains = Kept(self.end, 500_000), Kept(self.gap, 500_000), Kept(self.chain, 50_000)

    def __call__(self, word: str) -> str:
        return self[word]

    def _restore(self, word: str) -> str:
        core = TRAILING.sub("", LEADING.sub("", word))
        if core.isalpha() and not RUN.search(core):
            return core
        if core.isalpha() and not NEIGHBOURS.search(core):
            return self.doubled(core)
        if not any(c.isalpha() or c in STANDS_FOR for c in core):
            return ""
        score, text = self.best(core)
        return text if score > -number_cost(core) else ""

    def doubled(self, word: str) -> str:
        """What best() gives for letters whose repeated runs do not touch: one letter or two in each. The letter that
        follows a run makes the states one again, so each run is decided by the letters beside it."""
        out, at, table = [], 0, self.table
        for m in REPEATED.finditer(word):
            a, b = m.span()
            q, c, r = symbol(word[a - 1]) if a else EDGE, symbol(word[a]), symbol(word[b]) if b < len(word) else EDGE
            one = table[(q * SYMBOLS + c) * SYMBOLS + r] - SECOND_CHOICE
            two = table[(q * SYMBOLS + c) * SYMBOLS + c] + table[(c * SYMBOLS + c) * SYMBOLS + r] - (SECOND_CHOICE if b - a > 2 else 0.0)
            out.append(word[at : a + 1 + (two > one)])
            at = b
        return "".join(out) + word[at:]

    def lattice(self, word: str) -> list[list[tuple[str, float, list[int]]]]:
        """For each run of one sign: what it may stand for, the channel's cost, and the symbols."""
        return [arcs_of(c, min(3, len(list(run)))) for c, run in itertools.groupby(word)]

    def decode(self, word: str) -> str:
        return self.best(word)[1]

    def best(self, word: str) -> tuple[float, str]:
        """Viterbi over states of the last two letters: the score and the word."""
        states = self._step({(EDGE, EDGE): (0.0, None)}, self.lattice(word))
        score, path = max(((s + float(self.model[a, b, EDGE]), p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
        return score, spelled(path)

    def _step(self, states: dict, lattice: list) -> dict:
        """The states after a part of the lattice; a path is a linked list of what was put out."""
        table = self.table
        for arcs in lattice:
            after: dict = {}
            if len(states) == 1 and len(arcs) == 1:  # nothing to choose
                (((a, b), (score, path)),), ((out, cost, symbols),) = states.items(), arcs
                for k in symbols:
                    score += table[(a * SYMBOLS + b) * SYMBOLS + k]
                    a, b = b, k
                states = {(a, b): (score - cost, (path, out))}
                continue
            for (a, b), (score, path) in states.items():
                for out, cost, symbols in arcs:
                    s, x, y = score - cost, a, b
                    for k in symbols:
                        s += table[(x * SYMBOLS + y) * SYMBOLS + k]
                        x, y = y, k
                    old = after.get((x, y))
                    if old is None or s > old[0]:
                        after[(x, y)] = (s, (path, out) if out else path)
            states = after
        return states

    def end(self, token: str) -> tuple[str, str, str] | None:
        """The word of a token, its beginning and its end with the signs beside them; None of fewer than two letters."""
        core = token.rstrip(".,;:!?")
        if core.isalpha():  # most words; no search where there is one reading
            word = self[core] if RUN.search(core) else core
            return (word, word[:2], word[-2:] + "." * (len(token) - len(core))) if len(word) > 1 else None
        word = self[token]
        if len(word) < 2:
            return None
        core = LEADING.sub("", token)
        return word, "." * (len(token) - len(core)) + word[:2], word[-2:] + "." * (len(core) - len(TRAILING.sub("", core)))

    def chain(self, key: tuple[str, tuple[str, ...], str]) -> tuple[list[str], list[str]]:
        """Words of pieces between the end `left` and the beginning `right` of two words (or ""): the first goes on with
        the left word, the last begins the right one. Then the runs of single signs, each as one word."""
        left, pieces, right = key
        start = tuple(map(symbol, left[:2])) if left else (EDGE, EDGE)
        states = {start: (0.0, None)}
        signs = len(left) - 2 if left else 0
        single = False
        for piece in pieces:
            states = self._space(states, signs, single and len(piece) == 1)
            single = len(piece) == 1
            whole = {}
            if (cost := number_cost(piece)) < math.inf:  # a number, or signs alone
                for (a, b), (s, p) in states.items():
                    if b == EDGE and ((a, b) not in whole or s - cost > whole[(a, b)][0]):
                        whole[(a, b)] = (s - cost, p)
            states = self._step(states, self.lattice(piece))
            for k, v in whole.items():
                if k not in states or v[0] > states[k][0]:
                    states[k] = v
            signs = 0
        head = right.lstrip(".")
        states = self._space(states, len(right) - len(head)) if right else self._step(states, [[arc(" ", 0.0)]])
        path = max(self._step(states, [[arc(c, 0.0)] for c in head]).values(), key=lambda x: x[0])[1]
        words = spelled(path)
        runs = ["".join(g) for one, g in ((k, list(g)) for k, g in itertools.groupby(pieces, key=lambda x: len(x) == 1)) if one and len(g) >= 3]
        return (words[: -len(head)] if head else words).split(" "), [self[r] for r in runs]

    def _space(self, states: dict, signs: int, among_signs: bool = False) -> dict:
        """A space with `signs` signs beside it: a word end, or put in by the channel."""
        end, drop = (END_AMONG_SIGNS, DROP_AMONG_SIGNS) if among_signs else (0.0, DROP_SPACE + DROP_SIGN * signs)
        return self._step(states, [[arc(" ", end), arc("", drop)]])

    def gap(self, key: tuple[str, str] | None) -> bool:
        """Whether the space between two words was put in, by the end and the beginning beside it; beside a piece, whose
        key is None, it has to be decided with the piece."""
        if key is None:
            return True
        left, right = key
        (a, b), (c, d) = map(symbol, left[:2]), map(symbol, right[-2:])
        m = self.model
        apart = m[a, b, EDGE] + m[b, EDGE, c] + m[EDGE, c, d]
        joined = m[a, b, c] + m[b, c, d] - DROP_SPACE - DROP_SIGN * (len(left) + len(right) - 4)
        return bool(joined > apart)


def number_cost(word: str) -> float:
    """The cost of a word without letters as a number or signs, a run of one sign counted once; infinite for others."""
    if any(c.isalpha() for c in word):
        return math.inf
    return sum(DIGIT if c.isalnum() else DROP_LETTERLIKE if c in STANDS_FOR else DROP_SIGN for c, _ in itertools.groupby(word))


def spelled(path) -> str:
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def words_of(text: str | None, restore: Restorer) -> set[str]:
    """The distinct restored words of a whole text, spaces that the channel put in removed."""
    if not text:
        return set()
    gaps, chains = restore.gaps, restore.chains
    tokens = text.lower().split()
    found = list(map(restore.ends.__getitem__, tokens))
    words = {end[0] for end in set(found) if end}
    # before which tokens something has to be decided: where a piece stands, or a space that was put in
    keys = [(a[2], b[1]) if a and b else None for a, b in itertools.pairwise(found)]
    events = [i for i, hit in enumerate(map(gaps.__getitem__, keys), 1) if hit]
    if found and found[0] is None:
        events.insert(0, 0)
    n, i = len(tokens), 0
    for event in events:
        if event < i:
            continue
        i = event
        # the word so far, the end of its last part
        line, tail = (found[i - 1][0], found[i - 1][2]) if i and found[i - 1] else ("", "")
        joined, pieces = False, []
        while i < n:
            end = found[i]
            if end is None:
                pieces.append(tokens[i])
                i += 1
                continue
            word, head, after = end
            if pieces:
                got, runs = chains[tail, tuple(pieces), head]
                pieces = []
                words.update(runs)
                if len(got) > 1:
                    words.add(line + got[0])
                    words.update(got[1:-1])
                    line = got[-1] + word
                else:
                    line += got[0] + word
            elif tail and gaps[tail, head]:
                line += word
            else:
                break
            joined, tail = True, after
            i += 1
        if pieces:
            got, runs = restore.chain((tail, tuple(pieces), ""))
            words.update(runs)
            words.add(line + got[0])
            words.update(got[1:])
        elif joined:
            words.add(line)
    words.discard("")
    return words


def features(word: str) -> list[str]:
    return [f"{word}$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def marks(words: str, known=None) -> set[str]:
    """The distinct features of words joined by blanks; of those in `known` only."""
    found = {f for w in words.split() for f in features(w)}
    return found if known is None else found & known.keys()


def fit(docs: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Weights of the features that mark toxic documents, of the words of each, joined by blanks; "" is the bias. One
    class only: its share. Features of toxic documents are counted first, so that the many others take no memory."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    base = math.log((n1 + 0.5) / (n0 + 0.5))
    if not n1 or not n0:
        return {"": base}
    often = collections.Counter()
    for i in np.flatnonzero(toxic):
        often.update(marks(docs[i]))
    seen = {f: [0, c1] for f, c1 in often.items() if c1 >= LEAST_TOXIC}
    del often
    for i in np.flatnonzero(toxic == 0):
        for f in marks(docs[i], seen):
            seen[f][0] += 1
    gain = []
    for f, (c0, c1) in seen.items():
        p = (c0 + c1) / (n0 + n1)
        z = (c1 / n1 - c0 / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        if z > 4.5 and c1 / n1 > 3 * (c0 + 0.5) / n0:
            gain.append((-z, f))
    names = {f: j for j, (_, f) in enumerate(sorted(gain)[:MAX_FEATURES])}
    rows, cols = [], []
    for i, words in enumerate(docs):
        for j in sorted(names[f] for f in marks(words, names)):
            rows.append(i)
            cols.append(j)
    rows, cols = np.array(rows, int), np.array(cols, int)
    w, bias, y = np.zeros(len(names)), base, toxic.astype(float)
    square, square_bias = np.full(len(names), 1e-8), 1e-8
    for _ in range(800):  # projected AdaGrad: weights stay at 0 or above, so only marks of toxicity count
        d = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], len(docs)) + bias, -30, 30))) - y
        g = np.bincount(cols, d[rows], len(names)) + 0.02 * w
        square, square_bias = square + g * g, square_bias + d.sum() ** 2
        w = np.maximum(0.0, w - 0.4 * g / np.sqrt(square))
        bias -= 0.4 * d.sum() / math.sqrt(square_bias)
    return {"": float(bias)} | {f: float(w[j]) for f, j in names.items() if w[j] > 1e-3}


def labelled(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, toxic) that a model may learn from: not held out, with a label."""
    return labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def held_out(doc_id: str):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(df: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float]]:
    """The character model over all texts of df and the weights from at most MAX_TRAIN labelled ones."""
    model = language_model((r[0], r[1]) for r in trigram_counts(df).collect())
    chosen = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)

    def run(batches):
        restore = Restorer(model)
        for batch in batches:
            words = [" ".join(sorted(words_of(t, restore))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), pa.array(words)], ["h", "toxic", "words"])

    some = df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).join(F.broadcast(chosen), "doc_id").select("h", F.col("toxic").cast("int"), "text")
    some = some.mapInArrow(run, "h long, toxic int, words string").orderBy("h", "toxic", "words").limit(MAX_TRAIN)  # ids may repeat; reruns agree
    some = [r[1:] for r in some.collect()]
    return model, fit([words for _, words in some], np.array([min(1, max(0, toxic)) for toxic, _ in some], int))


def score(df: DataFrame, model: np.ndarray, weights: dict[str, float], keep: list[str]) -> DataFrame:
    """The columns `keep` of df and SCORE (0 to 1) of each whole text."""
    common.prepare(df.sparkSession)

    def run(batches):
        restore = Restorer(model)

        known = Kept(lambda word: sum(weights[f] for f in features(word) if f in weights), 1_000_000)
        for batch in batches:
            out = []
            for text in batch.column("__text").to_pylist():
                total = math.fsum(map(known.__getitem__, words_of(text, restore))) + weights[""]
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], [*keep, SCORE])

    names = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema) + f", {SCORE} double"
    return df.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def digest(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    common.prepare(df.sparkSession)
    model, weights = train(df, labels)
    return score(df, model, weights, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose score stays under the threshold."""
    common.prepare(df.sparkSession)
    model, weights = train(df, labels)
    return score(df, model, weights, df.columns).where(F.col(SCORE) < threshold).select(*df.columns)
