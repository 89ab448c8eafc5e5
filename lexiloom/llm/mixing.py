"""Mixing sources to target weights by balanced sampling (cube method).

Each source has a rate, its target over its size, between 0 and `cap`. The whole part of the rate is
taken from every document; the fraction is an inclusion probability, and the cube method turns the
probabilities into 0 or 1: three documents at a time move along the null space of the two balancing
constraints (documents and words), so both totals stay as they are. Blocks of a source run apart
(hot sources have many); each leaves at most two undecided documents, which meet in the next, much
smaller level. In the last block of a source the flight lands: of the last two documents one more is
settled with the words kept and the number of documents let go, the last one is rounded, and the words
that are then missing or too many are made up by changing the choice of as few documents as fit.

Defined results: null and empty texts have size 0 and take 0; sources without words have target 0; a
null source is a source; ties and repeated rows are separate units; reruns agree; null ids are units like
others; texts of any length are counted whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import common

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 8192


def sizes(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Rows (source, source_size, n_docs, target). Shares follow the weights; with those targets that
    reach `cap` times their size held there, the level of the rest is found from running sums over the
    sources in the order in which they reach it."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    per = per.withColumn("reach", cap * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    held, lighter = F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - held) / (F.sum("weight").over(everything) - lighter)
    per = per.withColumn("level", level)
    level = F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(everything)  # the first that holds; later ones are lower
    target = F.least(F.coalesce(level * F.col("weight"), F.lit(0.0)), cap * F.col("source_size"))
    return per.withColumn("target", target).select("source", "source_size", "n_docs", "target")


TINY = 1e-12


def _moved(prob: list[float], active: list[int], move: tuple[float, ...], rng: random.Random) -> list[int]:
    """Move the active probabilities along `move`, either way by chance so that none changes on average, until one is
    0 or 1; those still between are returned."""
    up = min((1 - prob[i]) / v if v > 0 else prob[i] / -v for i, v in zip(active, move, strict=True) if v)
    down = min(prob[i] / v if v > 0 else (1 - prob[i]) / -v for i, v in zip(active, move, strict=True) if v)
    step = up if rng.random() * (up + down) < down else -down
    for i, v in zip(active, move, strict=True):
        prob[i] = settled(prob[i] + step * v)
    return [i for i in active if 0.0 < prob[i] < 1.0]


def settled(p: float) -> float:
    return 0.0 if p <= TINY else 1.0 if p >= 1 - TINY else p


def flight(prob: list[float], size: list[int], rng: random.Random) -> list[float]:
    """Move probabilities to 0 or 1 under constant sum and constant size-weighted sum; at most two stay between."""
    prob, active, nxt, n = list(map(settled, prob)), [], 0, len(prob)
    while True:
        while len(active) < 3 and nxt < n:
            if 0.0 < prob[nxt] < 1.0:
                active.append(nxt)
            nxt += 1
        if len(active) < 2 or (len(active) == 2 and size[active[0]] != size[active[1]]):
            return prob
        if len(active) == 2:
            move = (1.0, -1.0)
        else:
            a, b, c = (size[i] for i in active)
            move = (float(c - b), float(a - c), float(b - a)) if a != b or b != c else (1.0, -1.0, 0.0)
        active = _moved(prob, active, move, rng)


def landing(before: list[float], prob: list[float], size: list[int], rng: random.Random) -> list[float]:
    """Settle the few undecided after the flight from `before`: the words are kept, then the number of documents."""
    prob = list(prob)
    active = [i for i, p in enumerate(prob) if 0.0 < p < 1.0]
    while len(active) > 1:  # of two, one is settled along the words' null space
        a, b = size[active[0]], size[active[1]]
        active = _moved(prob, active[:2], (float(b), -float(a)) if a or b else (1.0, -1.0), rng) + active[2:]
    for i in active:
        prob[i] = float(rng.random() < prob[i])
    free = sorted((i for i, p in enumerate(before) if 0.0 < settled(p) < 1.0), key=lambda i: -size[i])
    missing = math.fsum(before[i] * size[i] for i in free) - sum(size[i] for i in free if prob[i])
    for i in free:  # largest first, so few change
        add = missing > 0
        if 0 < size[i] <= abs(missing) and prob[i] == float(not add):
            prob[i] = float(add)
            missing += -size[i] if add else size[i]
    add = missing > 0
    least = min((i for i in free if size[i] and prob[i] == float(not add)), key=lambda i: size[i], default=None)
    if least is not None and size[least] < 2 * abs(missing):
        prob[least] = float(add)
    return prob


def _level(frame: DataFrame, block: int, seed: int) -> DataFrame:
    """One level: the flight in each block, and the landing where the block is all that its source has left."""

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "rep", "size"], kind="stable")
        head = pdf.iloc[0]
        rng = random.Random(f"{seed}/{head['source']}/{head['block']}/{len(pdf)}")
        size, before = [int(x) for x in pdf["size"]], [float(x) for x in pdf["prob"]]
        prob = flight(before, size, rng)
        return pdf.assign(prob=landing(before, prob, size, rng) if head["n_docs"] <= block else prob)

    return frame.groupBy("source", "block").applyInPandas(decide, frame.schema)


def decide(sized: DataFrame, weights=(1, 2, 3), cap: float = 3.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, rep, source, size, source_size, target, copies) of (doc_id, rep, source, size)."""
    goal = common.materialize(targets(sized, weights, cap), "mix-targets")
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    units = sized.join(goal.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    units = units.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long")).withColumn("prob", F.col("rate") - F.col("base")).drop("rate")
    done, level = [], 0
    while True:
        blocks = F.greatest(F.ceil(F.col("n_docs") / F.lit(block)), F.lit(1)).cast("long")
        units = units.withColumn("block", F.pmod(F.xxhash64("doc_id", "rep", F.lit(level)), blocks))
        settled = common.materialize(_level(units, block, seed + level), "mix-level")
        if most <= block:
            done.append(settled)
            break
        within = (F.col("prob") > 0) & (F.col("prob") < 1)
        done.append(settled.where(~within))
        units = settled.where(within)
        left = units.groupBy("source").agg(F.count("*").alias("n_docs"))
        left = common.materialize(left.withColumnRenamed("source", "source_"), "mix-left")
        most = left.agg(F.max("n_docs")).first()[0] or 0
        if not most:
            break
        units = units.drop("n_docs").join(left, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").select(*settled.columns)
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "rep", "source", "size", "source_size", "target", (F.col("base") + F.col("prob").cast("long")).alias("copies"))


def mix(df: DataFrame, weights=(1, 2, 3), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of df, each as often as the mix takes it. Rows without words are never taken."""
    common.prepare(df.sparkSession)
    names = df.columns
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "source"))
    keyed = df.withColumn("__rep", F.row_number().over(same))
    sized = keyed.select("doc_id", "source", F.col("__rep").alias("rep"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    chosen = decide(common.materialize(sized, "mix-sizes"), weights, cap, seed).where("copies > 0 and size > 0").select(F.col("doc_id").alias("__id"), F.col("rep").alias("__r"), "copies")
    taken = keyed.join(chosen.withColumnRenamed("copies", "__copies"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__rep") == F.col("__r")))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*names)


def digest(df: DataFrame) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) of every document."""
    common.prepare(df.sparkSession)
    sized = common.materialize(sizes(df).withColumn("rep", F.lit(0).cast("int")), "mix-sizes")
    out = decide(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
