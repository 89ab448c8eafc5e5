"""Edit-aware token counts: a segment tree of pre-token runs per document, kept beside the text.

A text is cut at safe boundaries (where every match of the split pattern ends) into runs of about
LEAF_CHARS characters. Leaves hold the characters and tokens of a run, inner nodes their sums. trees()
adds a document's leaves as a column, so that later edits never encode the whole text again. An edit
(pos, n_del, ins; positions in code points of the text as it then is) re-encodes only the runs it touches
and the runs at its borders, whose end could stop being safe; what becomes too long is cut into runs anew,
and the sums above are updated. A single match of the pattern (a word of any length) is never cut.

Defined results: null and empty texts have no tokens; null edits count as none; positions and lengths
beyond the text are clamped; edits apply in the order given; repeated rows repeat; a null doc_id stays
null; a null tree is built; other columns are ignored.
"""

from __future__ import annotations

import itertools

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import bpe, common

LEAF_CHARS = 512


TREE = "struct<chars: array<int>, tokens: array<int>>"
FORM = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


class CountTree:
    """Sums of (characters, tokens) over a list of text runs. With the leaves of a kept tree nothing is encoded."""

    def __init__(self, text: str, count, leaf: int = LEAF_CHARS, kept: dict | None = None):
        self.count, self.leaf, self.encoded = count, leaf, 0
        if kept and sum(kept["chars"]) == len(text):
            ends = list(itertools.accumulate(kept["chars"]))
            self._build([text[e - n : e] for e, n in zip(ends, kept["chars"], strict=True)] or [""], kept["tokens"] or [0])
        else:
            runs = bpe.safe_parts(text, leaf) if text else [""]
            self._build(runs, list(map(self._count, runs)))
        self.encoded = 0

    def _build(self, runs: list[str], tokens: list[int]) -> None:
        self.runs = runs
        self.width = 1 << max(0, len(runs) - 1).bit_length()
        rest = [0] * (self.width - len(runs))
        self.chars, self.tokens = [0] * self.width + list(map(len, runs)) + rest, [0] * self.width + list(tokens) + rest
        for k in range(self.width - 1, 0, -1):
            self._pull(k)

    def _count(self, run: str) -> int:
        self.encoded += len(run)
        return self.count(run) if run else 0

    def _pull(self, k: int) -> None:
        self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, pos: int) -> tuple[int, int]:
        """The run that holds character `pos`, and where that run begins; the last run for a position at the end."""
        k, begin = 1, 0
        if pos >= self.chars[1]:
            i = len(self.runs) - 1
            return i, self.chars[1] - len(self.runs[i])
        while k < self.width:
            k *= 2
            if pos - begin >= self.chars[k]:
                begin += self.chars[k]
                k += 1
        return k - self.width, begin

    def edit(self, pos: int, n_del: int, ins: str) -> None:
        total = self.chars[1]
        pos = min(max(pos, 0), total)
        n_del = min(max(n_del, 0), total - pos)
        first, begin = self.find(max(pos - 1, 0))
        last, _ = self.find(min(pos + n_del + 1, total))
        joined = "".join(self.runs[first : last + 1])
        at = pos - begin
        joined = joined[:at] + ins + joined[at + n_del :]
        parts = bpe.safe_parts(joined, self.leaf) if len(joined) > 2 * self.leaf else [joined]
        tokens = list(map(self._count, parts))
        room = last + 1 - first
        if len(parts) > room:  # more runs than before: the leaves move, their sums are added up again
            held = self.tokens[self.width : self.width + len(self.runs)]
            held[first : last + 1] = tokens
            self._build([*self.runs[:first], *parts, *self.runs[last + 1 :]], held)
            return
        for i, (part, n) in enumerate(zip(parts + [""] * (room - len(parts)), tokens + [0] * (room - len(parts)), strict=True), first):
            self.runs[i], k = part, self.width + i
            self.chars[k], self.tokens[k] = len(part), n
            while k > 1:
                k //= 2
                self._pull(k)

    def text(self) -> str:
        return "".join(self.runs)

    def leaves(self) -> dict:
        """What is kept of the tree: the runs' characters and tokens."""
        filled = [i for i, r in enumerate(self.runs) if r]
        return {"chars": [len(self.runs[i]) for i in filled], "tokens": [self.tokens[self.width + i] for i in filled]}


def _counter(path: str | None, pattern: str):
    path = path or bpe.ranks_path()
    return lambda s: len(bpe.encode_text(s, path, pattern))


def trees(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (doc_id, text, edits, tree) of a table with doc_id, text and edits array<struct<pos, n_del, ins>>; the tree
    holds the leaves of each document."""
    common.prepare(df.sparkSession)
    path = path or bpe.ranks_path()

    def run(batches):
        count = _counter(path, pattern)
        for batch in batches:
            for part in common.slices(batch, "text"):
                kept = [CountTree(t or "", count).leaves() for t in part.column("text").to_pylist()]
                yield part.append_column("tree", pa.array(kept, FORM))

    df = df.select("doc_id", "text", "edits")
    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", tree {TREE}")


def apply_edits(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_tree: bool = False) -> DataFrame:
    """Rows (doc_id, n_before, n_after, n_chars_after, n_reencoded [, text, tree]) of rows of trees(), after their edits;
    n_reencoded counts characters, text and tree are those after the edits."""
    common.prepare(df.sparkSession)
    path = path or bpe.ranks_path()
    names = ["doc_id", "n_before", "n_after", "n_chars_after", "n_reencoded"]

    def run(batches):
        count = _counter(path, pattern)
        for batch in batches:
            for part in common.slices(batch, "text"):
                out = [[] for _ in range(6)]
                for text, edits, kept in zip(*(part.column(c).to_pylist() for c in ("text", "edits", "tree")), strict=True):
                    tree = CountTree(text or "", count, kept=kept)
                    before = tree.tokens[1]
                    for e in edits or []:
                        if e is not None:
                            tree.edit(e["pos"] or 0, e["n_del"] or 0, e["ins"] or "")
                    for column, x in zip(out, (before, tree.tokens[1], tree.chars[1], tree.encoded), strict=False):
                        column.append(x)
                    if with_tree:
                        out[4].append(tree.text())
                        out[5].append(tree.leaves())
                more = [pa.array(out[4], pa.string()), pa.array(out[5], FORM)] if with_tree else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:4]), *more], names + ["text", "tree"] * with_tree)

    schema = ", ".join(f"{c} long" for c in names) + f", text string, tree {TREE}" * with_tree
    return df.select("doc_id", "text", "edits", "tree").mapInArrow(run, schema)


def counts(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (doc_id, n_before, n_after, n_chars_after, n_reencoded) of a table with doc_id, text and edits: trees are
    written to the shared folder once, and edits then work on what was kept."""
    return apply_edits(common.materialize(trees(df, path, pattern), "count-trees"), path, pattern)


def sample_edits(doc_id="doc_id", text="text"):
    """Three edits for any document, derived from its id: a replacement, an insertion and a deletion."""
    size = F.coalesce(F.char_length(text), F.lit(0))
    spot = lambda salt: F.pmod(F.xxhash64(F.col(doc_id), F.lit(salt)), size + 1).cast("int")
    step = lambda pos, n, ins: F.struct(pos.alias("pos"), F.lit(n).alias("n_del"), F.lit(ins).alias("ins"))
    return F.array(step(spot(1), 7, "edited words"), step(spot(2), 0, " it's 2026;\n\n"), step(spot(3), 23, ""))
