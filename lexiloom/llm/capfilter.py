"""Near-duplicate vectors by spherical-cap filters.

Filter directions are a structured random product code: a rotated vector is cut into pieces, each piece
has its own list of random unit codewords, and every combination of one codeword a piece is a direction.
A vector passes the filters whose direction it exceeds ALPHA with; list decoding finds all of them by
extending partial sums that can still reach ALPHA. Vectors meet in filters that at least two of them
pass, and the cosine is then taken exactly. ALPHA follows from the number of vectors, so that unlike
vectors rarely meet, and the length of a code from the number of filters a vector shall pass
(EXPECTED / TURNS). The number of codes follows from a miss that is measured for the dimension and count
in use: rotations are independent, so two vectors share no filter with the power of the chance that they
share none under one rotation, and codes are added until that is below MISS at cosine 0.98. Where more
than MOST_TURNS would be needed (few dimensions, many vectors: caps narrower than the angle of a link),
wider caps are taken instead, so that more unlike vectors meet and are compared, but no link is given up.

Equal vectors of a label are one class. A filter with many classes is dealt in pairs of blocks; a pair
counts only in the first filter that it shares, so that nothing is counted twice and no pairs are sent.
Filters are first counted by class and number alone; then a class is sent to each filter that another one
passes too, about EXPECTED times, as packed components in their own width and packed filter numbers.

Defined results: rows whose label or vec_id is null, or whose vector is null, empty, zero or holds null
or non-finite components, link with nothing; vectors of other lengths do not link; repeated rows count
as other vectors; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import common
from lexiloom.llm.onebit import takes_part, vectors

COSINE, EXPECTED, TURNS, BLOCK, BATCH_ROWS = 0.98, 60, 15, 1024, 20_000
MISS, MOST_TURNS, PROBES, PROBE_PAIRS = 1e-4, 48, 8, 500


def cap_threshold(dim: int, chance: float) -> float:
    """The inner product that a random unit vector has with a fixed one with probability `chance`, or more."""
    t = np.linspace(-1, 1, 200_001)
    density = np.maximum(0.0, 1 - t * t) ** ((dim - 3) / 2)
    tail = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-tail / tail[0], -chance)])


class ProductCode:
    """Directions of a dimension, as TURNS or more product codes under different rotations, and the threshold.

    Each code has `pieces` lists of `size` codewords. One code's numbers of passed filters vary with the
    few codewords nearest to a vector's pieces, so independent rotations are used.
    """

    def __init__(self, dim: int, count: int, seed: int = 5):
        self._build(dim, *plan(dim, count, seed), seed)

    @classmethod
    def of(cls, dim: int, chance: float, turns: int, seed: int) -> ProductCode:
        code = cls.__new__(cls)
        code._build(dim, chance, turns, seed)
        return code

    def _build(self, dim: int, chance: float, turns: int, seed: int):
        self.pieces = 1 if dim < 8 else 2 if chance > 1e-7 else 3
        self.size = math.ceil((EXPECTED / TURNS / chance) ** (1 / self.pieces)) if dim >= 8 else 8
        self.alpha = cap_threshold(dim, chance) if dim >= 8 else 0.6
        rng = np.random.default_rng(seed)
        self.cuts = np.linspace(0, dim, self.pieces + 1).astype(int)
        self.codes = []
        for _ in range(turns):
            q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
            words = []
            for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
                w = rng.standard_normal((self.size, b - a))
                words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt((b - a) / dim))
            self.codes.append((q * np.sign(np.diag(r)), words))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that rows of unit vectors pass."""
        found = [self._decode(unit, turn, words) for turn, words in self.codes]
        row = np.concatenate([r for r, _ in found])
        return row, np.concatenate([c + k * self.size**self.pieces for k, (_, c) in enumerate(found)])

    def _decode(self, unit: np.ndarray, turn: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        y = (unit @ turn).astype(np.float32)
        parts = [y[:, a:b] @ w.T.astype(np.float32) for a, b, w in zip(self.cuts[:-1], self.cuts[1:], words, strict=True)]
        rest = np.cumsum([p.max(1) for p in parts][::-1], axis=0)[::-1]  # the most that later pieces can add
        row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for j, part in enumerate(parts):
            least = self.alpha - (rest[j + 1] if j + 1 < len(parts) else np.zeros(len(unit)))
            out = []
            for a in range(0, len(row), 512):
                r, t = row[a : a + 512], total[a : a + 512]
                i, c = np.nonzero(t[:, None] + part[r] >= least[r][:, None])
                out.append((r[i], code[a : a + 512][i] * self.size + c, t[i] + part[r[i], c]))
            row, code, total = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (row[:0], code[:0], total[:0])
        return row, code


def pairs_at(dim: int, cosine: float, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of random unit vectors at this cosine (equal ones in one dimension)."""
    u = unit_rows(rng.standard_normal((n, dim)))
    if dim == 1:
        return u, u
    w = rng.standard_normal((n, dim))
    w = unit_rows(w - (w * u).sum(1, keepdims=True) * u)
    return u, cosine * u + math.sqrt(1 - cosine * cosine) * w


def missed(u: np.ndarray, v: np.ndarray, decode) -> int:
    """How many pairs (u, v) share no filter of `decode`."""
    (r, f), (s, g) = decode(u), decode(v)
    return len(u) - len({i for i, _ in {*zip(r.tolist(), f.tolist(), strict=True)} & {*zip(s.tolist(), g.tolist(), strict=True)}})


@functools.lru_cache(64)
def plan(dim: int, count: int, seed: int = 5) -> tuple[float, int]:
    """(chance, turns): that of a random vector to pass a filter, and the codes that keep the miss below MISS."""
    chance = min(0.005, 0.1 / max(1, count)) if dim >= 8 else 0.2
    while True:
        code, rng = ProductCode.of(dim, chance, PROBES, seed), np.random.default_rng(seed + 1)
        n = PROBES * PROBE_PAIRS
        one = sum(missed(*pairs_at(dim, COSINE, PROBE_PAIRS, rng), lambda x, c=c: code._decode(x, *c)) for c in code.codes) / n
        one += 3 * math.sqrt(max(one * (1 - one), 1 / n) / n)  # the estimate's own error
        turns = math.ceil(math.log(MISS) / math.log(one)) if one < 1 else MOST_TURNS + 1
        if turns <= MOST_TURNS or dim < 8:
            return chance, max(TURNS, turns)
        chance *= 2


def unit_rows(arrays) -> np.ndarray:
    x = np.stack([np.asarray(a, np.float64) for a in arrays])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passed(classes: DataFrame, count: int, kind: str) -> DataFrame:
    """Rows (rep, label, dim, weight, x, filters) of the classes (rep, label, x, weight): the components packed as `kind`
    and the numbers of all filters that the class passes, ascending, packed in 64 bits."""
    names = ["rep", "label", "dim", "weight", "x", "filters"]

    def run(batches):
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            dims = pdf["x"].map(len)
            for dim, some in pdf.groupby(dims):
                if dim not in codes:
                    codes[dim] = ProductCode(dim, count)
                x = np.stack(some["x"].to_numpy())
                row, filt = codes[dim].decode(unit_rows(x))
                order = np.lexsort((filt, row))
                lists = np.split(filt[order], np.searchsorted(row[order], np.arange(1, len(x))))
                yield pa.RecordBatch.from_arrays([pa.array(some["rep"].to_numpy()), pa.array(some["label"].to_numpy().astype(np.int64)), pa.array(np.full(len(x), dim, np.int32)), pa.array(some["weight"].to_numpy()), common.binary(list(x.astype(kind))), common.binary(lists)], names)

    return classes.select("rep", "label", "x", "weight").mapInArrow(run, "rep long, label long, dim int, weight long, x binary, filters binary")


def unpacked_filters(table: DataFrame) -> DataFrame:
    """Rows (rep, label, dim, filter) of the packed filters."""

    def run(batches):
        for batch in batches:
            lists = [np.frombuffer(f, np.int64) for f in batch.column("filters").to_pylist()]
            row = np.repeat(np.arange(len(lists)), list(map(len, lists)))
            if len(row):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("rep", "label", "dim")), pa.array(np.concatenate(lists))], ["rep", "label", "dim", "filter"])

    return table.select("rep", "label", "dim", "filters").mapInArrow(run, "rep long, label long, dim int, filter long")


def _links(x, rep, side, lo, hi, filters, here):
    """Linked pairs (u, v) of rows of one pair of blocks of the filter `here`, each in its first filter only."""
    a = np.flatnonzero(side == lo)
    b = a if lo == hi else np.flatnonzero(side == hi)
    if not len(a) or not len(b):
        return a[:0], b[:0]
    cos = x[a] @ x[b].T
    u, v = np.nonzero(cos >= COSINE - 1e-9)
    if lo == hi:
        u, v = u[u < v], v[u < v]
    near = np.flatnonzero(np.abs(cos[u, v] - COSINE) <= 1e-9)
    u, v = a[u], b[v]
    if len(near):  # too near the threshold for a matrix product's rounding
        exact = (x[u[near]] * x[v[near]]).sum(1) >= COSINE
        keep = np.ones(len(u), bool)
        keep[near[~exact]] = False
        u, v = u[keep], v[keep]
    if len(u) > 2000:
        number = {f: k for k, f in enumerate(sorted({f for fs in filters for f in fs if f < here}))}
        m = np.zeros((len(filters), len(number) + 1), np.float32)
        for r, fs in enumerate(filters):
            m[r, [number[f] for f in fs if f < here]] = 1
        earlier = (m @ m.T)[u, v] > 0.5
    else:
        sets = {i: {f for f in filters[i] if f < here} for i in {*u.tolist(), *v.tolist()}}
        earlier = np.array([not sets[i].isdisjoint(sets[j]) for i, j in zip(u.tolist(), v.tolist(), strict=True)], bool)
    return u[~earlier], v[~earlier]


def _cells(pdf: pd.DataFrame, kind: str) -> pd.DataFrame:
    """Links of many pairs of blocks: their number a class, and the edges of a spanning forest."""
    pdf = pdf.sort_values(["label", "dim", "filter", "lo", "hi", "rep"]).reset_index(drop=True)
    key = pdf[["label", "dim", "filter", "lo", "hi"]].to_numpy()
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    rep, side, weight = (pdf[c].to_numpy() for c in ("rep", "side", "weight"))
    links: dict[int, int] = {}
    parent: dict[int, int] = {}
    edges = []

    def root(r):
        while parent.setdefault(r, r) != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    for s, e in zip(start, [*start[1:], len(pdf)], strict=True):
        _, _, here, lo, hi = key[s]
        u, v = _links(unit_rows([np.frombuffer(x, kind) for x in pdf["x"].iloc[s:e]]), rep[s:e], side[s:e], lo, hi, [np.frombuffer(f, np.int64).tolist() for f in pdf["filters"].iloc[s:e]], here)
        n = np.bincount(u, weight[s:e][v], e - s) + np.bincount(v, weight[s:e][u], e - s)
        for i in np.flatnonzero(n):
            links[int(rep[s + i])] = links.get(int(rep[s + i]), 0) + int(n[i])
        for i, j in zip(rep[s:e][u].tolist(), rep[s:e][v].tolist(), strict=True):
            if (p := root(i)) != (q := root(j)):
                parent[p] = q
                edges.append((i, 0, j))
    return pd.DataFrame([*((r, n, r) for r, n in links.items()), *edges], columns=["rep", "links", "to"], dtype="int64")


def near_duplicates(df: DataFrame) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of every vector."""
    spark = df.sparkSession
    common.prepare(spark)
    rows = vectors(df.where("label is not null"), ("label",)).withColumn("label", F.col("label").cast("long"))
    classes = common.materialize(rows.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "cap-classes")
    count = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    kind = "<f4" if df.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    held = common.materialize(passed(classes, count, kind), "cap-passed")
    met = unpacked_filters(held)
    several = met.groupBy("label", "dim", "filter").agg(F.count("*").alias("members")).where("members > 1")
    met = met.join(several, ["label", "dim", "filter"])
    full = met.join(held, ["rep", "label", "dim"])
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    full = full.withColumn("side", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    full = full.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("other", "members")
    sent = common.materialize(full, "cap-full")
    batches = max(1, sent.count() // BATCH_ROWS)
    full = sent.withColumn("batch", F.pmod(F.xxhash64("label", "dim", "filter", "lo", "hi"), F.lit(batches)))
    cells = common.materialize(full.groupBy("batch").applyInPandas(lambda pdf: _cells(pdf, kind), "rep long, links long, to long"), "cap-links")
    common.discard(sent, held)
    links = cells.groupBy("rep").agg(F.sum("links").alias("links"))
    group = common.components(cells.where("rep <> `to`").select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("vertex", "rep")
    found = classes.select("label", "x", "rep", "weight").join(links, "rep", "left").join(group, "rep", "left")
    found = found.select(F.col("label").alias("l"), F.xxhash64("label", "x").alias("h"), F.col("x").alias("y"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = common.materialize(found, "cap-found")
    linked = rows.join(found, (F.xxhash64("label", "x") == F.col("h")) & (F.col("label") == F.col("l")) & (F.col("x") == F.col("y")))
    linked = linked.select("vec_id", "n_links", "component_id")
    alone = df.where(~(F.col("label").isNotNull() & takes_part())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
