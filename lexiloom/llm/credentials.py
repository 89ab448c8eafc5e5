"""Secret scans: three fixed kinds of spans, and more by an automaton inferred from them.

One pass over the texts finds the fixed kinds (assign, access, hex) and the candidates that none of them
covers: tokens of LEAST_LONG characters or more, and shorter ones of LEAST_SHORT or more that mix letters and
digits. Values of found credentials, a bounded sample of distinct ones (MAX_EXAMPLES), build a prefix tree
over character classes; states whose outgoing frequencies agree within Hoeffding's bound are merged into a
probabilistic automaton. Every candidate is then scored by its likelihood under the automaton against a
model of pairs of classes in all texts; those that look like the format are added as spans of kind `format`.
The least score comes from examples that were held back. A short candidate has to reach SHORT_TOTAL in all.

Defined results: null and empty texts have no spans; with fewer than 8 distinct examples of LEAST_LONG
characters, too few to learn and hold back, nothing is added; positions are code points with exclusive ends;
repeated rows repeat; fixed spans always stay; texts and tokens of any length are scanned whole; a null doc_id
stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import common

#: The three kinds and their smallest sizes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "format")
LEAST_LONG, LEAST_SHORT = 16, 8
LONG = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SHORT = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z+/_.=-]*+[0-9][A-Za-z0-9+/_.=-]*+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
MIXED = re.compile(r"(?=[^0-9]*[0-9])[^A-Za-z]*[A-Za-z]")
SIGNS = "+/_.=-"

MAX_EXAMPLES, ALPHA, QUANTILE, MARGIN, SHORT_TOTAL = 1000, 0.05, 0.02, 0.4, 16.0
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_.=-")
CLASS_OF = {c: i for i, cs in enumerate(CLASSES) for c in cs}
K = len(CLASSES)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[str], list[tuple[int, int]]]:
    """Fixed spans (kind, start, end) in order, the credentials in them, and the long tokens outside."""
    spans, found = [], []
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, m.end()))
                found.append(m[2])
    runs = []
    for m in LONG.finditer(text):
        run, at = m[0], m.start()
        runs.append((at, m.end()))
        if "AKIA" in run:
            for x in ACCESS.finditer(run):
                if x.end() - x.start() >= 20:
                    spans.append((at + x.start(), 1, at + x.end()))
                    found.append(x[0])
        for x in HEX.finditer(run):  # a run of fewer than LEAST_LONG characters holds none
            if x.end() - x.start() >= 24:
                spans.append((at + x.start(), 2, at + x.end()))
                found.append(x[0])
    short = [m.span() for m in SHORT.finditer(text) if LEAST_SHORT <= m.end() - m.start() < LEAST_LONG]
    if short:
        runs = sorted(runs + short)
    spans.sort()
    rest, i, covered = [], 0, 0
    for a, b in runs:  # what the fixed spans leave of a run, without the sign that joins it to one
        at = max(a, covered)
        while True:
            s, e = (spans[i][0], spans[i][2]) if i < len(spans) and spans[i][0] < b else (b, None)
            x, y = at, s
            if x < y:
                x += x > a and text[x] in SIGNS
                y -= y < b and x < y and text[y - 1] in SIGNS
                rest += [m.span() for m in TOKEN.finditer(text, x, y) if m.end() - m.start() >= LEAST_LONG or MIXED.match(m[0])]
            if e is None:
                break
            i, covered = i + 1, max(covered, e)
            at = max(at, covered)
    return [(k, s, e) for s, k, e in spans], found, rest


def byte_classes() -> np.ndarray:
    """The class of each byte, K for those that are in none."""
    out = np.full(256, K, np.int64)
    for c, k in CLASS_OF.items():
        out[ord(c)] = k
    return out


def class_pairs(texts: list[str], classes: np.ndarray) -> np.ndarray:
    """How often each class follows each other, or K anything else, in texts; (K + 1) K numbers."""
    now = classes[np.frombuffer("\n".join(texts).encode(), np.uint8)]
    before = np.concatenate([[K], now[:-1]])
    return np.bincount((before * K + now)[now < K], minlength=(K + 1) * K)


def scan(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fixed spans, credentials and candidates of every document, without the texts; and, where `pairs` is set, rows of
    class pairs of the texts outside fixed spans, one a task."""
    names = [*keep, "base", "found", "at", "tokens", "pairs"]

    def run(batches):
        classes, pairs, like = byte_classes(), np.zeros((K + 1) * K, np.int64), None
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = [base_spans(t) for t in texts]
                pairs += class_pairs([blanked(t, r[0]) for t, r in zip(texts, rows, strict=True)], classes)
                like = pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in keep),
                        pa.array([[f"{KINDS[k]}:{s}:{e}" for k, s, e in r[0]] for r in rows], pa.list_(pa.string())),
                        pa.array([r[1] for r in rows], pa.list_(pa.string())),
                        pa.array([[a for a, _ in r[2]] for r in rows], pa.list_(pa.int32())),
                        pa.array([[t[a:b] for a, b in r[2]] for t, r in zip(texts, rows, strict=True)], pa.list_(pa.string())),
                        pa.nulls(len(texts), pa.binary()),
                    ],
                    names,
                )
                yield like
        if like is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in like.columns[:-1]), common.binary([pairs])], names)

    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, "text").mapInArrow(run, f"{head}base array<string>, found array<string>, at array<int>, tokens array<string>, pairs binary")


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """A text with a blank in place of each fixed span."""
    if not spans:
        return text
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], " "]
        at = max(at, e)
    return "".join([*out, text[at:]])


class Automaton:
    """A probabilistic automaton over character classes, merged from a prefix tree of examples."""

    def __init__(self, examples: list[str]):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        self.total = [0]
        for text in sorted(examples):
            state = 0
            for c in text:
                k = CLASS_OF[c]
                self.total[state] += 1
                self.count[state][k] = self.count[state].get(k, 0) + 1
                if k not in self.next[state]:
                    self.next[state][k] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.total.append(0)
                state = self.next[state][k]
            self.total[state] += 1
        self._merge()

    def _agree(self, a: int, b: int) -> bool:
        """Whether the two states' frequencies, and those of all states after them, are compatible."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for k in {*self.count[a], *self.count[b]}:
                if abs(self.count[a].get(k, 0) / n - self.count[b].get(k, 0) / m) > bound:
                    return False
            stack += [(x, self.next[b][k]) for k, x in self.next[a].items() if k in self.next[b] and (x, self.next[b][k]) != (a, b) and min(self.total[x], self.total[self.next[b][k]]) >= 8]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the state a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.total[a] += self.total[b]
            for k, n in self.count[b].items():
                self.count[a][k] = self.count[a].get(k, 0) + n
            for k, y in self.next[b].items():
                if k in self.next[a]:
                    stack.append((self.next[a][k], y))
                else:
                    self.next[a][k] = y

    def _merge(self) -> None:
        """Red states are final; each fringe state joins the first red state that it agrees with."""
        red, seen = [0], {0}
        while True:
            fringe = [(-self.total[y], y, x, k) for x in red for k, y in self.next[x].items() if y not in seen]
            if not fringe:
                break
            _, y, x, k = min(fringe)
            for r in red:
                if self._agree(r, y):
                    self.next[x][k] = r
                    self._fold(r, y)
                    break
            else:
                red.append(y)
                seen.add(y)
        number = {s: i for i, s in enumerate(red)}
        self.step = np.zeros((len(red), K), int)
        self.logp = np.zeros((len(red), K))
        for s, i in number.items():
            p = np.array([self.count[s].get(k, 0) + 0.02 for k in range(K)], float)
            self.logp[i] = np.log(p / p.sum())
            for k in range(K):
                self.step[i, k] = number[self.next[s][k]] if k in self.next[s] else 0
        del self.next, self.count, self.total

    def score(self, classes: list[int]) -> float:
        state, total = 0, 0.0
        for k in classes:
            total += self.logp[state, k]
            state = self.step[state, k]
        return float(total)


def summed(table: DataFrame) -> DataFrame:
    """The class pairs of all tasks, added up in at most 8 rows."""

    def run(batches):
        total = np.zeros((K + 1) * K, np.int64)
        for batch in batches:
            for x in batch.column("pairs").to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([common.binary([total])], ["pairs"])

    return table.where("pairs is not null").select("pairs").repartition(8).mapInArrow(run, "pairs binary")


def infer(table: DataFrame):
    """The automaton, the background model and the least score of a credential, of a scanned table; None without
    examples."""
    examples = table.select(F.explode("found").alias("x")).where(F.length("x") >= LEAST_LONG).distinct().orderBy(F.xxhash64("x"), "x").limit(MAX_EXAMPLES)
    examples = [r[0] for r in examples.collect()]
    if len(examples) < 8:
        return None
    total = summed(table).collect()
    pairs = np.ones((K + 1, K)) + sum(np.frombuffer(r[0], np.int64).reshape(K + 1, K) for r in total)
    background = np.log(pairs / pairs.sum(1, keepdims=True))
    held, learn = examples[::4], [x for i, x in enumerate(examples) if i % 4]
    machine = Automaton(learn)
    least = float(np.quantile([likeness(machine, background, x) for x in held], QUANTILE))
    return machine, background, max(MARGIN, least / 2)


def looks_like(model, token: str) -> bool:
    """Whether a candidate has the inferred format."""
    if model is None:
        return False
    machine, background, least = model
    score = likeness(machine, background, token)
    return score >= least and (len(token) >= LEAST_LONG or score * len(token) >= SHORT_TOTAL)


def likeness(machine: Automaton, background: np.ndarray, token: str) -> float:
    """Log-likelihood ratio per character of automaton and background."""
    classes = [CLASS_OF[c] for c in token]
    before = [K, *classes[:-1]]
    return (machine.score(classes) - float(background[before, classes].sum())) / max(1, len(classes))


def with_spans(table: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keep, n_assign, n_access, n_hex, base_sha256, spans) of a scanned table."""
    model = infer(table)

    def run(batches):
        kept: dict[str, bool] = {}

        def like(t: str) -> bool:
            got = kept.get(t)
            if got is None:
                if len(kept) > 200_000:
                    kept.clear()
                got = kept[t] = looks_like(model, t)
            return got

        for batch in batches:
            n, sha, spans = [[], [], []], [], []
            for base, at, tokens in zip(*(batch.column(c).to_pylist() for c in ("base", "at", "tokens")), strict=True):
                for i in range(3):
                    n[i].append(sum(b.startswith(f"{KINDS[i]}:") for b in base))
                sha.append(hashlib.sha256(",".join(base).encode()).hexdigest())
                more = [f"format:{a}:{a + len(t)}" for a, t in zip(at, tokens, strict=True) if like(t)]
                spans.append(",".join(sorted(base + more, key=lambda s: (int(s.split(":")[1]), KINDS.index(s.split(":")[0])))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string())], [*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keep).schema)
    return table.where("pairs is null").select(*keep, "base", "at", "tokens").mapInArrow(run, f"{head}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def digest(df: DataFrame) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    common.prepare(df.sparkSession)
    return with_spans(common.materialize(scan(df), "secret-scan"))


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of df with every found span replaced by `mark`, and n_chars, where there, counted anew."""
    common.prepare(df.sparkSession)
    table = common.materialize(scan(df, ()).select("found", "pairs"), "secret-scan")
    model = infer(table)
    common.discard(table)
    names = df.columns

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, _, rest = base_spans(text)
        spans = [(s, e) for _, s, e in base]
        spans += [(a, b) for a, b in rest if looks_like(model, text[a:b])]
        out, at = [], 0
        for s, e in sorted(spans):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array([clean(t) for t in part.column("text").to_pylist()], pa.string()))

    out = df.mapInArrow(run, df.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out
