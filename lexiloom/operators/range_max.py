"""Largest weight in ranges of places, for many ranges at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def range_max(vector: DataFrame, ranges: DataFrame, leftmost: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows (qid, value, index) of ranges (qid, l, u), both ends inclusive, over vector (idx, weight) with places from
    0. Ties go to the rightmost place, or the leftmost. Ranges beyond the vector or with l > u give nulls.

    A range is cut into its two edges, that meet single rows of at most two blocks, and whole aligned spans of
    blocks whose sizes are powers of two, about two a level, that meet maxima computed once for each span.
    """
    sign = -1 if leftmost else 1
    best = F.struct(F.col("weight").alias("w"), (F.col("idx") * sign).alias("i"))
    size = vector.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("size"))
    asked = ranges.select("qid", "l", "u").crossJoin(F.broadcast(size))  # one row
    asked = asked.where("l >= 0 and l <= u and u < size")
    rows = vector.select("idx", "weight", F.floor(F.col("idx") / block).alias("b"))
    blocks = rows.groupBy("b").agg(F.max(best).alias("best"))
    asked = asked.withColumn("lb", F.floor(F.col("l") / block)).withColumn("ub", F.floor(F.col("u") / block))
    edges = asked.select("qid", "l", "u", F.explode(F.array_distinct(F.array("lb", "ub"))).alias("b"))
    at_edges = edges.join(rows, "b").where("idx between l and u").groupBy("qid").agg(F.max(best).alias("best"))
    top = F.floor(F.log2(F.col("n_blocks") + 0.5)) + 1
    count = blocks.agg((F.max("b") + 1).alias("n_blocks"))
    spans = blocks.crossJoin(F.broadcast(count)).select("best", "b", F.explode(F.sequence(F.lit(0), top.cast("int"))).alias("k"))
    spans = spans.groupBy("k", F.expr("shiftright(cast(b as bigint), k)").alias("j")).agg(F.max("best").alias("best"))
    inner = asked.select("qid", (F.col("lb") + 1).alias("x"), F.col("ub").alias("y")).where("x < y")
    # dyadic cover of [x, y): at level k the span j is used if it fits and its parent does not
    inner = inner.select("qid", "x", "y", F.explode(F.expr("sequence(0, cast(floor(log2(y - x + 0.5)) as int))")).alias("k"))
    cover = inner.select("qid", "k", F.explode(F.expr("""filter(array_distinct(array(
        shiftright(x + shiftleft(1L, k) - 1, k), shiftright(y, k) - 1)),
        j -> shiftleft(j, k) >= x and shiftleft(j + 1, k) <= y
             and not (shiftleft(shiftright(j, 1), k + 1) >= x and shiftleft(shiftright(j, 1) + 1, k + 1) <= y))""")).alias("j"))
    within = cover.join(spans, ["k", "j"]).groupBy("qid").agg(F.max("best").alias("best"))
    found = at_edges.unionByName(within).groupBy("qid").agg(F.max("best").alias("best"))
    return ranges.select("qid").join(found, "qid", "left").select("qid", F.col("best.w").alias("value"), (F.col("best.i") * sign).alias("index"))
