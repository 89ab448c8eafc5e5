"""Nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length 1, padded and rotated at random; the signs of the result are its code. Two
scalars correct the estimate: the length and the alignment of code and vector. A query is rotated too
and quantised to 4 bits, so that an estimate is a few popcounts over packed words. The error bound tells
which vectors can still be among the nearest; those are ranked again by their exact products.

Codes and scalars are computed once for every row and written beside the vector, which is kept in its own
width. The query set is a stated share of the rows; it meets all rows in blocks of bounded size, so that a
row is sent once for QUERIES queries, and each block returns at most k rows a query. Nothing is left out: the
bound alone decides (EPSILON standard deviations; measured recall is in the tests). The scan itself grows with
rows times queries; vectors without clusters leave no list that a query could skip.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of another length than the query's are no candidates; ties go to the smaller vec_id; rows that repeat
a vec_id are candidates of other ids, none of their own; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import common

CODE_BITS, QUERY_BITS, EPSILON = 128, 4, 3.5
#: Rows and queries of a cell, for vectors of up to 64 components; of longer ones in proportion fewer.
ROWS, QUERIES = 8192, 4096
#: The bound's floor comes from the exact products of the FEW * k best estimates of a block.
FEW = 4


@functools.lru_cache(8)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """`dim` orthonormal rows of a random rotation of a space of at least CODE_BITS dimensions."""
    wide = max(CODE_BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def encoded(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows of vectors: codes as rows of words, their ones, and the scalars of the estimate and of its error."""
    wide = turn.shape[1]
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        y = (x / norm[:, None]) @ turn
        code = pack(y > 0)
        align = np.abs(y).sum(1) / np.sqrt(wide)
        scale = norm / align / np.sqrt(wide)
        spread = EPSILON * norm * np.sqrt(np.maximum(0.0, 1 - align**2)) / align / np.sqrt(wide - 1)
    wild = ~(np.isfinite(scale) & np.isfinite(spread))
    scale[wild], spread[wild] = 0.0, np.inf  # no estimate: always ranked by the exact product
    return code, np.bitwise_count(code).sum(1).astype(np.int64), scale, spread


class Codes:
    """Codes of a block of vectors, a row for each word of them, and estimates of their products with a query."""

    def __init__(self, code: np.ndarray, ones: np.ndarray, scale: np.ndarray, spread: np.ndarray, turn: np.ndarray):
        self.turn, self.wide = turn, turn.shape[1]
        self.code, self.ones, self.scale, self.spread = np.ascontiguousarray(code.T), ones.astype(np.float64), scale, spread
        self.both, self.bits = np.empty(len(code), np.uint64), np.empty(len(code), np.uint8)

    def estimate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with q, and how far off they may be."""
        z = q @ self.turn
        low = z.min()
        step = max((z.max() - low) / (2**QUERY_BITS - 1), 1e-300)
        u = np.rint((z - low) / step).astype(np.uint8)
        planes = pack(u >> np.arange(QUERY_BITS, dtype=np.uint8)[:, None] & 1)
        weighted = np.zeros(self.code.shape[1], np.uint32)
        for plane in planes[::-1]:
            weighted <<= 1
            for word, mask in zip(self.code, plane, strict=True):
                np.bitwise_and(word, mask, out=self.both)
                weighted += np.bitwise_count(self.both, out=self.bits)
        signed = 2 * step * weighted + (2 * low * self.ones - (low * self.wide + step * int(u.sum())))
        err = self.spread * np.linalg.norm(q) + self.scale * (EPSILON * step * np.sqrt(self.wide / 12))
        return signed * self.scale, err


def nearest(codes: Codes, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of a block, ids ascending, by exact products of those that the bound leaves."""
    est, err = codes.estimate(q)
    mine = slice(*np.searchsorted(ids, [own, own + 1]))
    est[mine], err[mine] = -np.inf, 0
    n = len(ids) - (mine.stop - mine.start)
    if n > k:
        few = min(n, FEW * k)
        first = np.argpartition(est, len(est) - few)[len(est) - few :]
        floor = np.partition((x[first] * q).sum(1), few - k)[few - k]
        rows = np.flatnonzero(est + err >= floor)
        rows = np.union1d(rows, first)
    else:
        rows = np.flatnonzero(est > -np.inf)
    exact = (x[rows] * q).sum(1)
    if len(rows) > k:
        top = np.flatnonzero(exact >= np.partition(exact, len(exact) - k)[len(exact) - k])
        rows, exact = rows[top], exact[top]
    order = np.lexsort((ids[rows], -exact))[:k]
    return rows[order], exact[order]


def takes_part():
    """Whether a row's vector has components, all of them finite numbers, and is not zero."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))


def vectors(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (vec_id, *extra, x: array of double) of the vectors that take part."""
    return df.where(takes_part()).select("vec_id", *extra, F.col("embedding").cast("array<double>").alias("x"))


def index(df: DataFrame) -> DataFrame:
    """Rows (vec_id, dim, x binary, code binary, ones, scale, spread) of the vectors that take part; x holds the
    components as floats or doubles, as they are in df."""
    common.prepare(df.sparkSession)
    kind = "<f4" if df.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches):
        for batch in batches:
            column = batch.column("x")
            dims = np.diff(column.offsets.to_numpy())
            flat, start = column.flatten().to_numpy(), np.cumsum(dims) - dims
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = flat[start[rows][:, None] + np.arange(dim)]
                code, ones, scale, spread = encoded(x, rotation(int(dim)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), common.binary(list(x.astype(kind))), common.binary(list(code)), pa.array(ones), pa.array(scale), pa.array(spread)], ["vec_id", "dim", "x", "code", "ones", "scale", "spread"])

    return vectors(df).mapInArrow(run, "vec_id long, dim int, x binary, code binary, ones long, scale double, spread double")


def search(df: DataFrame, query: DataFrame, k: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows of df for each row of query, itself apart."""
    rows = common.materialize(index(df), "onebit-index")
    asked = vectors(query).select("vec_id", "x")
    kind = "<f4" if df.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    n, widest = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    m, share = asked.count(), max(1.0, widest / 64)
    n_blocks, n_groups = max(1, math.ceil(n * share / ROWS)), max(1, math.ceil(m * share / QUERIES))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).withColumn("group", spread(n_groups))
    right = asked.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_groups)).cast("int")).withColumn("block", spread(n_blocks))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: list = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for dim, some in b.groupby(b["x"].map(len)):
            part = a[a["dim"] == dim].sort_values("vec_id")
            if not len(part):
                continue
            x = np.frombuffer(b"".join(part["x"]), kind).reshape(-1, dim).astype(np.float64)
            code = np.frombuffer(b"".join(part["code"]), np.uint64).reshape(len(x), -1)
            codes = Codes(code, *(part[c].to_numpy() for c in ("ones", "scale", "spread")), rotation(dim))
            ids = part["vec_id"].to_numpy()
            for own, q in zip(some["vec_id"], some["x"], strict=True):
                at, score = nearest(codes, x, ids, np.asarray(q), own, k)
                for column, values in zip(found, (np.full(len(at), own), ids[at], score), strict=True):
                    column.append(values)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, found), strict=True)))

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
