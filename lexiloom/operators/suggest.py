"""Top phrases for prefixes. Order everywhere: weight falling, then phrase, then row_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.scalars import ascii_lower, clamp_n_column
from lexiloom.plans.ranges import range_number

MOST, LENGTH = 32, 6
ORDER = (F.desc, F.asc, F.asc)


def order() -> list[Column]:
    return [f(c) for f, c in zip(ORDER, ("weight", "phrase", "row_id"), strict=True)]


def suggest(corpus: DataFrame, prefix: str, n: int = 16) -> DataFrame:
    """Rows (rank, phrase, score, snippet) for one prefix. The filter reaches the scan; the top n are kept per task."""
    lower = prefix.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    top = corpus.where(F.col("phrase").startswith(lower)).orderBy(*order()).limit(n)
    rank = F.row_number().over(Window.orderBy(*order()))  # over at most n rows
    return top.select(rank.alias("rank"), "phrase", F.col("weight").alias("score"), "snippet")


def prefix_range(corpus: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows (q, first, last): the half-open range of places whose phrases begin with q. Distinct prefixes are cut to
    each phrase's beginnings, counted per phrase first, so no prefix meets all phrases."""
    q = prefixes.select("q").distinct()
    per = corpus.groupBy("phrase").agg(F.count("*").alias("n"))
    tagged = per.select("phrase", "n", F.lit(None).cast("string").alias("q")).unionByName(q.select(F.col("q").alias("phrase"), F.lit(0).cast("long").alias("n"), "q"))
    spread = tagged.withColumn("part", range_number(tagged, ["phrase"]))
    parts = spread.groupBy("part").agg(F.sum("n").alias("in_part"))
    parts = parts.withColumn("before", F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).select("part", "before")
    within = Window.partitionBy("part").orderBy("phrase", F.col("q").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    first = spread.withColumn("smaller", F.coalesce(F.sum("n").over(within), F.lit(0))).where("q is not null").join(parts, "part").select("q", (F.col("before") + F.col("smaller")).alias("first"))
    lengths = F.transform(F.array_sort(F.collect_set(F.struct(F.char_length("q").alias("k")))), lambda x: x["k"])
    # every length is needed; k distinct ones take k^2 / 2 characters of prefixes, so this one row stays small
    every = q.agg(lengths.alias("lengths"))
    cut = per.crossJoin(F.broadcast(every)).withColumn("k", F.explode(F.filter("lengths", lambda k: k <= F.char_length("phrase"))))
    starts = cut.groupBy(F.substring("phrase", F.lit(1), F.col("k")).alias("q")).agg(F.sum("n").alias("n"))
    return first.join(starts, "q", "left").select("q", "first", (F.col("first") + F.coalesce("n", F.lit(0))).alias("last"))


def prefix_index(corpus: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """Rows (prefix, rank, row_id, weight, phrase, snippet): the best `most` of every prefix up to `length` characters,
    the empty one included. Each task keeps its own best before rows are shuffled, so short prefixes stay small."""
    spread = corpus.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.char_length("phrase"), F.lit(length)))))
    spread = spread.withColumn("prefix", F.substring("phrase", F.lit(1), F.col("k"))).drop("k")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(*order()))
    return spread.withColumn("rank", rank).where(F.col("rank") <= most).select("prefix", "rank", "row_id", "weight", "phrase", "snippet")


def suggest_batch(index: DataFrame, corpus: DataFrame, requests: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """Rows (qid, rank, phrase, score, snippet) for requests (qid, q, n). Prefixes up to `length` are looked up in the
    index by equality; longer ones meet the phrases with the same first `length` characters."""
    asked = requests.select("qid", ascii_lower(F.col("q")).alias("q"), clamp_n_column(F.col("n"), most).alias("n"))
    columns = ("qid", "rank", "phrase", "score", "snippet")
    short = asked.where(F.char_length("q") <= length).join(index, F.col("q") == F.col("prefix")).where(F.col("rank") <= F.col("n"))
    short = short.select("qid", "rank", "phrase", F.col("weight").alias("score"), "snippet")
    distinct = asked.where(F.char_length("q") > length).select("q").distinct()
    met = corpus.withColumn("start", F.substring("phrase", 1, length)).join(distinct.withColumn("start", F.substring("q", 1, length)), "start").where(F.col("phrase").startswith(F.col("q")))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(*order()))
    best = met.withColumn("rank", rank).where(F.col("rank") <= most).select("q", "rank", "phrase", F.col("weight").alias("score"), "snippet")
    long = asked.join(best, "q").where(F.col("rank") <= F.col("n")).select(*columns)
    return short.unionByName(long)


def naive_suggest(corpus: DataFrame, prefix: str, n: int = 16) -> DataFrame:
    """What suggest() gives, by ranking every phrase that begins with the prefix; to compare with."""
    q = ascii_lower(F.lit(prefix))
    found = corpus.where(F.substring("phrase", F.lit(1), F.length(q)) == q)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order()))).where(F.col("rank") <= n).select("rank", "phrase", F.col("weight").alias("score"), "snippet")


def fuzzy_suggest(corpus: DataFrame, text: str, distance: int = 2, n: int = 16) -> DataFrame:
    """Phrases that sound like `text` and are at most `distance` edits away, nearest and heaviest first."""
    from lexiloom.functions.scalars import edit_distance, soundex

    q = ascii_lower(F.lit(text))
    near = corpus.where(soundex(F.col("phrase")) == soundex(q)).withColumn("distance", edit_distance(F.col("phrase"), q)).where(F.col("distance") <= distance)
    return near.orderBy("distance", *order()).limit(n).select("phrase", F.col("weight").alias("score"), "snippet", "distance")
