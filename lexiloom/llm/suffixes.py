"""Removal of repeated byte strings by a sparse suffix order.

A byte goes if a WINDOW-byte string that covers it also starts in a document with a smaller doc_id.
Sorting every suffix with the bytes that decide would move some fifty times the text. So suffixes are
taken only at anchors: in each window the GRAM-byte string with the least hash (the leftmost, if
several). Equal windows choose equal anchors, so every repeat meets at one; an anchor comes every 16
bytes or so. Its windows in a document are consecutive, and together form a unit.

1. Suffixes at anchors, by their first GRAM bytes themselves, and their units are sorted by blocks
   (multikey: by eight bytes, ties by the next, ties by the unit's fingerprint, ties by document), cut at
   splitters sampled from the data, and merged by range. A unit that has an earlier document is a repeat
   with all its windows. Of suffixes with several units, the first document of each unit has windows
   compared one by one: those that begin SIDE bytes or more before the anchor if another unit has the same
   SIDE bytes there, the others if another has the same bytes behind it, by 16 bits of their hashes. Equal
   windows hold one or the other, so none is lost, and most chance neighbours send nothing. A splitter may
   fall inside a suffix that has many units, so that no suffix is too long for one task; the suffix at
   either boundary of a range is then compared with the boundary's own, and where they are equal all its
   windows are compared, as other units may lie beyond.
2. Those windows are merged likewise; the windows with an earlier document are repeats. A block hears only
   of documents before its own first.
3. Blocks of documents join what came back for them, and the removed runs are cut.

A block sends a suffix, unit or window once, with its smallest document, so that copies and frequent
passages cost a row a block; units come back by their number in the block. Leading bytes are compared as
they are; what is behind them in a unit by 48 bits, and single windows by 64 bits of a polynomial hash.

Defined results: null and empty texts have no bytes; a row with a null doc_id neither removes nor loses
anything; rows with the same doc_id do not remove each other; texts of any length are cut into strides;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import common

WINDOW, GRAM = 50, 20
SPAN = WINDOW - GRAM + 1
SIDE = (WINDOW - GRAM) // 2
BLOCK_BYTES, STRIDE, BUCKET_ROWS = 4_000_000, 1_000_000, 600_000
#: Windows are merged in so many turns, each of which removes what it has read.
TURNS = 4
NO_DOC = 2**63 - 1
#: The words of a suffix and its unit, in the order of sorting.
SUFFIX = ("s0", "s1", "s2")
KEY = (*SUFFIX, "unit")
#: What stands before and behind the anchor, by 16 bits; 0 where the unit has no windows on that side.
SIDES = ("left", "right")
VALUE = common.mix64(np.arange(1, 257, dtype=np.uint64))
BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd base modulo 2^64 and their inverses, as long as needed so far."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = np.full(n, np.uint64(BASE)), np.full(n, np.uint64(pow(BASE, -1, 1 << 64)))
            for x in (cls.up, cls.down):
                x[0] = 1
                np.multiply.accumulate(x, out=x)
        return cls.up, cls.down


def hashes(data: np.ndarray):
    """A function that gives the hashes of data[a:b] for arrays a and b."""
    up, down = Powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.add.accumulate(VALUE[data] * up[: len(data)], out=total[1:])
    return lambda a, b: common.mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def strides(off: np.ndarray):
    """Parts (first document, end document, first byte, end of windows) of about STRIDE bytes; a longer document is cut."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + STRIDE, "right")) - 1)
        for at in range(int(off[i]), max(int(off[j]), int(off[i]) + 1), STRIDE if j == i + 1 else 1 << 62):
            yield i, j, at, min(at + STRIDE, int(off[j])) if j == i + 1 else int(off[j])
        i = j


def leading(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The GRAM bytes from each position as three words, whose order is that of the bytes."""
    out = []
    for begin in range(0, GRAM, 8):
        word = np.zeros(len(at), np.uint64)
        for k in range(begin, begin + 8):
            word = word << np.uint64(8) | (data[at + k].astype(np.uint64) if k < GRAM else np.uint64(0))
        out.append(word)
    return out


def anchors(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Units of a block: document, first and last window, anchor, hashes of its sides, leading bytes of the suffix, unit
    hash; positions in the block."""
    out = []
    for i, j, begin, end in strides(off):
        stop = min(end + WINDOW - 1, int(off[j]))
        d = data[begin:stop]
        n = len(d) - WINDOW + 1
        if n <= 0:
            continue
        h = hashes(d)
        at = np.arange(len(d) - GRAM + 1)
        key = (h(at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        m = key
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[:n], m[SPAN - 16 : SPAN - 16 + n])
        anchor = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
        bounds = np.clip(off[i : j + 1] - begin, 0, len(d))
        doc = np.repeat(np.arange(i, j), np.diff(bounds))[:n]
        whole = np.arange(n) + WINDOW <= bounds[1:][doc - i]
        p = np.flatnonzero(whole)
        if not len(p):
            continue
        new = np.ones(len(p), bool)
        new[1:] = (anchor[p[1:]] != anchor[p[:-1]]) | (p[1:] != p[:-1] + 1)
        lo = p[new]
        hi = p[np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)]
        a = anchor[lo]
        unit = common.mix64(h(lo, hi + WINDOW) + (a - lo).astype(np.uint64)) >> np.uint64(16)  # of one suffix, 48 bits do
        out.append((doc[lo], lo + begin, hi + begin, a + begin, *sides(h, lo, hi, a), *leading(d, a), unit))
    names = ("doc", "lo", "hi", "at", *SIDES, *KEY)
    if not out:
        return {k: np.zeros(0, np.uint64 if k in KEY else np.uint16 if k in SIDES else np.int64) for k in names}
    return dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True))


def sides(h, lo: np.ndarray, hi: np.ndarray, a: np.ndarray) -> list[np.ndarray]:
    """Hashes of the SIDE bytes before the anchors, which each window holds that begins there or earlier, and of the
    bytes behind them that all other windows hold; 0 without such windows."""
    out = []
    for some, begin, end in ((lo <= a - SIDE, a - SIDE, a), (hi > a - SIDE, a + GRAM, a - SIDE + 1 + WINDOW)):
        key = np.zeros(len(a), np.uint16)
        key[some] = h(begin[some], end[some]) % np.uint64(0xFFFF) + np.uint64(1)
        out.append(key)
    return out


def side_runs(u: dict[str, np.ndarray], ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows (first, number) of units that are asked for the windows left (1), right (2) or both (3)."""
    cut = np.clip(u["at"] - SIDE + 1, u["lo"], u["hi"] + 1)  # the first window that is not left
    lo, end = np.where(ask & 1, u["lo"], cut), np.where(ask & 2, u["hi"] + 1, cut)
    some = lo < end
    return lo[some], (end - lo)[some]


def multikey_order(*words: np.ndarray) -> np.ndarray:
    """The order by several words: by the first, and only where that ties by the next, and so on."""
    order = np.argsort(words[0])
    for k in range(1, len(words)):
        same = np.ones(len(order), bool)
        for w in words[:k]:
            x = w[order]
            same[1:] &= x[1:] == x[:-1]
        same[:1] = False
        run = np.cumsum(~same)
        tied = same.copy()
        tied[:-1] |= same[1:]
        t = np.flatnonzero(tied)
        if len(t):
            order[t] = order[t][np.lexsort((words[k][order[t]], run[t]))]
    return order


def firsts(*words: np.ndarray) -> np.ndarray:
    new = np.ones(len(words[0]), bool)
    new[1:] = False
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    return new


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    parts = [a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(arrays[0]).to_bytes(8, "little"), *parts]))


def split48(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint16)


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def blocks_of(df: DataFrame) -> DataFrame:
    """Rows (block, doc_ids, offsets, texts): documents packed in blocks of about BLOCK_BYTES."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        z, seq, held, size = zstandard.ZstdCompressor(level=3), 0, [], 0
        base = TaskContext.get().partitionId() << 32

        def block():
            ids = np.concatenate([b.column("doc_id").fill_null(NO_DOC).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
            parts = [common.text_buffer(b.column("text")) for b in held]
            lengths = np.concatenate([np.diff(o) for _, o in parts])
            return pa.RecordBatch.from_arrays([pa.array([base + seq]), common.binary([ids]), common.binary([np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]), pa.array([z.compress(b"".join(d.tobytes() for d, _ in parts))], pa.binary())], ["block", "doc_ids", "offsets", "texts"])

        for batch in batches:
            for part in common.slices(batch, "text", BLOCK_BYTES // 4):
                held.append(part)
                size += len(common.text_buffer(part.column("text"))[0])
                if size >= BLOCK_BYTES:
                    yield block()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield block()

    return df.select("doc_id", "text").mapInArrow(run, "block long, doc_ids binary, offsets binary, texts binary")


def opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids (null as the largest), offsets and bytes of a block."""
    import zstandard

    return np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["offsets"], np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)


def known_units(ids: np.ndarray, off: np.ndarray, data: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Units of documents that have an id, in multikey order, and that of their documents' ids."""
    u = anchors(data, off)
    keep = ids[u["doc"]] != NO_DOC
    u = {k: v[keep] for k, v in u.items()}
    doc = ids[u["doc"]]
    order = multikey_order(*(u[k] for k in KEY), doc)
    return {k: v[order] for k, v in u.items()}, doc[order]


def cut_at(splitters: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted keys."""
    ends = np.concatenate([[0], np.searchsorted(keys, splitters, "left"), [len(keys)]])
    return [(b, int(ends[b]), int(ends[b + 1])) for b in range(len(ends) - 1) if ends[b] < ends[b + 1]]


def places(splitters: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """Where the splitters stand in sorted keys, both of several words, before equal keys."""
    left, right = (np.searchsorted(keys[0], splitters[0], side) for side in ("left", "right"))
    for i in np.flatnonzero(left < right):  # ties in the first word
        lo, hi = left[i], right[i]
        for words, points in zip(keys[1:], splitters[1:], strict=True):
            lo, hi = (lo + np.searchsorted(words[lo:hi], points[i], side) for side in ("left", "right"))
        left[i] = lo
    return left


def planes(words: np.ndarray) -> np.ndarray:
    """The bytes of words, all first ones first; of sorted words most of them repeat."""
    return words.view(np.uint8).reshape(len(words), -1).T.reshape(-1, len(words))


def sent(keys: list[np.ndarray], doc: np.ndarray, several: np.ndarray) -> bytes:
    s0, s1, s2, unit = keys
    return packed(*planes(s0), *planes(s1), *planes((s2 >> np.uint64(32)).astype(np.uint32)), *split48(unit), doc, several)


def received(blob: bytes) -> list[np.ndarray]:
    """s0, s1, s2, unit, document and whether several of the block have it."""
    *parts, low, high, doc, several = unpacked(blob, *[np.uint8] * GRAM, np.uint32, np.uint16, np.int64, np.uint8)
    whole = lambda some, kind: np.ascontiguousarray(np.stack(some, 1)).view(kind).ravel()
    s2 = whole(parts[16:], np.uint32).astype(np.uint64) << np.uint64(32)
    return [whole(parts[:8], np.uint64), whole(parts[8:16], np.uint64), s2, low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), doc, several]


def suffix_rows(blocks: DataFrame, splitters: list[np.ndarray]) -> DataFrame:
    """Rows (bucket, block, begin, payload, near): a block's suffixes and units, each once with its first document, and
    their sides; `begin` is the number in the block of the first of them."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                u, doc = known_units(*opened(row))
                if not len(doc):
                    continue
                start = np.flatnonzero(firsts(*(u[k] for k in KEY)))
                last = np.append(start[1:], len(doc)) - 1
                several = (doc[last] != doc[start]).astype(np.uint8)
                keys, near, d = [u[k][start] for k in KEY], [u[k][start] for k in SIDES], doc[start]
                ends = np.concatenate([[0], places(splitters, keys), [len(d)]])
                cuts = [(b, int(ends[b]), int(ends[b + 1])) for b in np.flatnonzero(ends[:-1] < ends[1:]).tolist()]
                payload = pa.array([sent([k[x:y] for k in keys], d[x:y], several[x:y]) for _, x, y in cuts], pa.binary())
                sides_of = pa.array([packed(*(k[x:y] for k in near)) for _, x, y in cuts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in cuts], pa.int32()), pa.array([row["block"]] * len(cuts), pa.int64()), pa.array([x for _, x, _ in cuts], pa.int64()), payload, sides_of], ["bucket", "block", "begin", "payload", "near"])

    return blocks.mapInArrow(run, "bucket int, block long, begin long, payload binary, near binary")


def sample_splitters(blocks: DataFrame, n: int) -> list[np.ndarray]:
    """n - 1 keys that part a sample of at most 32 blocks' units evenly; they only place rows."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, off, data = opened(row)
                u = anchors(data[: off[-1]], off)
                order = multikey_order(*(u[k] for k in KEY))
                some = order[:: max(1, len(order) // 2000)]
                yield pa.RecordBatch.from_arrays([common.binary([u[k][some]]) for k in KEY], list(KEY))

    none = [np.zeros(0, np.uint64)] * len(KEY)
    if n < 2:
        return none
    ids = [r[0] for r in blocks.select("block").orderBy(F.xxhash64("block")).limit(32).collect()]
    some = blocks.where(F.col("block").isin(ids)).select("doc_ids", "offsets", "texts")
    got = some.mapInArrow(run, ", ".join(f"{k} binary" for k in KEY)).collect()
    keys = [np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[k], np.uint64) for r in got)]) for k in KEY]
    if not len(keys[0]):
        return none
    order = multikey_order(*keys)
    picks = order[np.linspace(0, len(order) - 1, n + 1).astype(int)[1:-1]]
    keys = [k[picks] for k in keys]
    new = firsts(*keys)
    return [k[new] for k in keys]


def merged_suffixes(rows: DataFrame, splitters: list[np.ndarray]) -> DataFrame:
    """Rows (block, payload): the units that matter to a block by their numbers in it, each with its first document of
    all, and which of its windows have to be compared one by one: left (1), right (2) or both (3)."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [received(p) for p in pdf["payload"]]
        sizes = [len(p[0]) for p in parts]
        owner = np.repeat(pdf["block"].to_numpy(), sizes)
        number = np.concatenate([b + np.arange(n) for b, n in zip(pdf["begin"], sizes, strict=True)])
        *keys, d, several = (np.concatenate(x) for x in zip(*parts, strict=True))
        near = (np.concatenate(x) for x in zip(*(unpacked(p, np.uint16, np.uint16) for p in pdf["near"]), strict=True))
        order = multikey_order(*keys, d)
        keys, d, several, owner, number = [k[order] for k in keys], d[order], several[order], owner[order], number[order]
        unit = firsts(*keys)
        mine = d[np.flatnonzero(unit)][np.cumsum(unit) - 1]  # first document of the unit
        group = np.cumsum(firsts(*keys[:3])) - 1
        spread = np.zeros(len(d), bool)
        bucket = int(pdf["bucket"].iloc[0])
        for at in (bucket - 1, bucket):  # the boundaries of the range: beyond them the suffix may go on
            if 0 <= at < len(splitters[0]):
                spread |= np.logical_and.reduce([k == p[at] for k, p in zip(keys[:3], splitters[:3], strict=True)])
        ask = spread.astype(np.uint8) * np.uint8(3)
        for bit, side in enumerate(near):
            ask |= shared(group, side[order], unit) << np.uint8(bit)
        ask[d != mine] = 0
        keep = (d > mine) | (several > 0) | (ask > 0)
        mine, ask, owner, number = mine[keep], ask[keep], owner[keep], number[keep]
        order = np.lexsort((number, owner))
        owner = owner[order]
        out = []
        start = np.flatnonzero(firsts(owner)) if len(owner) else []
        for x, y in zip(start, [*start[1:], len(owner)][: len(start)], strict=True):
            o = order[x:y]
            out.append((owner[x], packed(number[o].astype(np.uint32), mine[o], ask[o])))
        return pd.DataFrame(out, columns=["block", "payload"])

    return rows.groupBy("bucket").applyInPandas(merge, "block long, payload binary")


def shared(group: np.ndarray, side: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """1 where several units of a group have the same side; `unit` marks the first row of each."""
    out = np.zeros(len(group), np.uint8)
    some = np.flatnonzero((np.bincount(group, unit) > 1)[group] & (side > 0))
    _, at, n = np.unique(group[some] << 16 | side[some], return_inverse=True, return_counts=True)
    out[some] = (np.bincount(at, unit[some], len(n)) > 1)[at]
    return out


def _block_rows(left: pd.DataFrame) -> list[dict]:
    return left.to_dict("records")


def matched_units(blocks: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """Rows (kind, bucket, block, payload). Kind 0: removed runs (begin, end) of a block; 1: runs of windows
    to compare (first, number); from 2 on, by turn: the hashes of these by bucket, each with its first document."""

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in _block_rows(left) if len(right) else []:
            ids, off, data = opened(row)
            u, doc = known_units(ids, off, data)
            parts = [unpacked(p, np.uint32, np.int64, np.uint8) for p in right["payload"]]
            number, first_doc, asked = (np.concatenate(x) for x in zip(*parts, strict=True))
            unit = np.cumsum(firsts(*(u[k] for k in KEY))) - 1
            mine, ask = np.full(unit[-1] + 1, NO_DOC), np.zeros(unit[-1] + 1, np.uint8)
            mine[number], ask[number] = first_doc, asked
            mine, ask = mine[unit], ask[unit]
            gone = mine < doc
            out.append((0, -1, row["block"], packed(*runs_of(u["lo"][gone], u["hi"][gone] + WINDOW, False))))
            open_ = (ask > 0) & (mine == doc)
            lo, n = side_runs({k: v[open_] for k, v in u.items()}, ask[open_])
            if not n.sum():
                continue
            o = np.argsort(lo)
            out.append((1, -1, row["block"], packed(lo[o], n[o])))
            w, d, _ = open_windows(ids, off, data, lo, n)
            o = multikey_order(w, d)
            w, d = w[o], d[o]
            first = firsts(w)
            w, d = w[first], d[first]
            for b, x, y in cut_at(np.array([k * ((1 << 64) // buckets) for k in range(1, buckets)], np.uint64), w):
                out.append((2 + b % TURNS, b, row["block"], packed(w[x:y], d[x:y])))
        return pd.DataFrame(out, columns=["kind", "bucket", "block", "payload"])

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(match, "kind int, bucket int, block long, payload binary")


def open_windows(ids, off, data, lo, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document id and begin of the windows in runs of n from lo."""
    p = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    d = np.repeat(ids[np.searchsorted(off, lo, "right") - 1], n)
    return np.concatenate([_window_hashes(data, p[x : x + STRIDE]) for x in range(0, len(p), STRIDE)]), d, p


def _window_hashes(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hashes of the WINDOW bytes at positions p, by powers of the base over the window."""
    up, _ = Powers.get(WINDOW)
    total = np.zeros(len(p), np.uint64)
    for k in range(WINDOW):
        total += VALUE[data[p + k]] * up[k]
    return common.mix64(total + np.uint64(WINDOW))


def merged_windows(rows: DataFrame) -> DataFrame:
    """Rows (block, payload): windows of a block that also start in a document before the block's first one, with it."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(p, np.uint64, np.int64) for p in pdf["payload"]]
        owner = np.repeat(pdf["block"].to_numpy(), [len(p[0]) for p in parts])
        w, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = multikey_order(w, d)
        w, d, owner = w[order], d[order], owner[order]
        first = firsts(w)
        mine = d[np.flatnonzero(first)][np.cumsum(first) - 1]
        w, mine, owner = (x[mine < d] for x in (w, mine, owner))
        order = np.argsort(owner, kind="stable")
        out, start = [], np.flatnonzero(firsts(owner[order])) if len(owner) else []
        for x, y in zip(start, [*start[1:], len(owner)][: len(start)], strict=True):
            o = order[x:y]
            out.append((owner[order[x]], packed(w[o], mine[o])))
        return pd.DataFrame(out, columns=["block", "payload"])

    return rows.groupBy("bucket").applyInPandas(merge, "block long, payload binary")


def runs_of(begin: np.ndarray, end: np.ndarray, touching: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping, and if so asked touching, spans."""
    if not len(begin):
        return begin, end
    o = np.argsort(begin, kind="stable")
    begin, end = begin[o], np.maximum.accumulate(end[o])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1] if touching else begin[1:] >= end[:-1]
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def cut_texts(blocks: DataFrame, found: DataFrame, with_text: bool) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept binary]) of blocks and found (kind, block, payload)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in _block_rows(left):
            ids, off, data = opened(row)
            spans = [np.stack(unpacked(p, np.int64, np.int64)) for p in right["payload"][right["kind"] == 0]]
            pending = [unpacked(p, np.int64, np.int64) for p in right["payload"][right["kind"] == 1]]
            known = [unpacked(p, np.uint64, np.int64) for p in right["payload"][right["kind"] == 2]]
            for lo, n in pending:
                have, d, p = open_windows(ids, off, data, lo, n)
                w, mine = (np.concatenate(x) for x in zip((have, d), *known, strict=True))
                o = multikey_order(w, mine)
                w, mine = w[o], mine[o]
                first = firsts(w)
                w, mine = w[first], mine[first]
                gone = mine[np.searchsorted(w, have)] < d
                spans.append(np.stack([p[gone], p[gone] + WINDOW]))
            begin, end = np.concatenate(spans, axis=1) if spans else np.zeros((2, 0), np.int64)
            doc = np.searchsorted(off, begin, "right") - 1
            o = np.argsort(doc, kind="stable")
            bounds = np.searchsorted(doc[o], np.arange(len(ids) + 1))
            for i in range(len(ids)):
                text = data[off[i] : off[i + 1]]
                mine = o[bounds[i] : bounds[i + 1]]
                a, b = runs_of(begin[mine] - off[i], end[mine] - off[i])
                kept = b"".join(text[x:y].tobytes() for x, y in zip([0, *b], [*a, len(text)], strict=True))
                out.append((None if ids[i] == NO_DOC else int(ids[i]), len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(cut, schema)


def remove_repeats(df: DataFrame, with_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    spark = df.sparkSession
    common.prepare(spark)
    blocks = common.materialize(blocks_of(df), "suffix-blocks")
    size = blocks.agg(F.count("*")).first()[0]
    buckets = max(1, round(size * BLOCK_BYTES / 13 / BUCKET_ROWS))
    splitters = sample_splitters(blocks, buckets)
    replies = common.materialize(merged_suffixes(suffix_rows(blocks, splitters), splitters), "suffix-replies")
    common.free_shuffles(spark)
    found = common.materialize(matched_units(blocks, replies, buckets), "suffix-found", by=("kind",))
    common.discard(replies)
    common.free_shuffles(spark)
    replies = found.where("kind < 2").select("kind", "block", "payload")
    for turn in range(2, 2 + min(TURNS, buckets)):
        more = common.materialize(merged_windows(found.where(F.col("kind") == turn).select("bucket", "block", "payload")), "suffix-windows")
        replies = replies.unionByName(more.select(F.lit(2).alias("kind"), "block", "payload"))
        common.discard(found, only=f"kind={turn}")
        common.free_shuffles(spark)
    return cut_texts(blocks, replies, with_text)
