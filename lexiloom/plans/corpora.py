"""Phrase corpora made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.scalars import ascii_lower


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names by how often they are ordered; counted per part before the names join."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    named = per.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").groupBy(ascii_lower(F.col("p_name")).alias("phrase"))
    return named.agg(F.sum("n").alias("weight"), F.min("p_partkey").alias("row_id")).select("row_id", "weight", "phrase", F.lit("").alias("snippet"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents by how often they occur; row_id is 0, as phrases are distinct."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(ascii_lower(F.col("text")), "[^a-z]+")).alias("phrase")).where("phrase <> ''")
    return words.groupBy("phrase").agg(F.count("*").alias("weight")).select(F.lit(0).cast("long").alias("row_id"), "weight", "phrase", F.lit("").alias("snippet"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a record, so with equal phrases and ties."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("long").alias("weight"), ascii_lower(F.col("p_name")).alias("phrase"), F.col("p_type").alias("snippet"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a file would have them, sound and odd ones by turns."""
    p = table(spark, sf_dir, "part")
    kind, key, name = F.col("p_partkey") % 8, F.col("p_partkey").cast("string"), F.col("p_name")
    tab = F.lit("\t")
    line = (
        F.when(kind == 0, F.concat(key, tab, name))
        .when(kind == 1, F.concat(F.lit("-"), key, tab, F.lit(" "), name, F.lit(" "), tab, F.col("p_type"), tab, F.col("p_brand")))
        .when(kind == 2, F.concat(tab, name))
        .when(kind == 3, F.concat(F.lit("  "), key, F.lit(".5 x"), tab, tab, F.upper(name)))
        .when(kind == 4, key)
        .when(kind == 5, F.concat(tab, key, tab, name, tab))
        .when(kind == 6, F.concat(F.lit("w"), key, tab, name, F.lit("\r")))
        .otherwise(F.concat(F.lit("99999999999"), tab, name))
    )
    return p.select((F.col("p_partkey") - 1).alias("line_no"), line.alias("value"))


def order_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole order prices by place in key order: (idx, weight)."""
    from lexiloom.sources.corpus import with_index

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.lit("").alias("phrase"), F.floor("o_totalprice").cast("long").alias("weight"))
    return with_index(o.withColumn("phrase", F.lpad(F.col("row_id").cast("string"), 20, "0"))).select("idx", "weight")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range for every customer, spread over all orders; some beyond them or turned round."""
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))  # one row
    c = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n))
    low = (F.col("c_custkey") * 7919) % F.col("n")
    high = low + (F.col("c_custkey") * 104729) % F.col("n") - 10
    return c.select(F.col("c_custkey").alias("qid"), low.cast("long").alias("l"), high.cast("long").alias("u"))
