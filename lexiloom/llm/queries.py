"""The queries of this package, by name; each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, capfilter, common, credentials, editcount, fsjoin, mixing, onebit, suffixes, tokenstore, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_onebit_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return onebit.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op3_source_mix(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_cap_filter_dedup(spark, sf_dir):
    return capfilter.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_token_store(spark, sf_dir):
    common.prepare(spark)
    path = common.fresh_path(spark, "token-store")
    tokenstore.write(table(spark, sf_dir, "documents"), path)
    return tokenstore.read(spark, path)


def op6_repeated_spans(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_edit_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return editcount.counts(docs.select("doc_id", "text", editcount.sample_edits().alias("edits")))


def op9_secrets(spark, sf_dir):
    return credentials.digest(table(spark, sf_dir, "documents"))


def op10_shingle_join(spark, sf_dir):
    return fsjoin.join(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_onebit_neighbours, op3_source_mix, op4_cap_filter_dedup, op5_token_store, op6_repeated_spans, op7_toxicity, op8_edit_counts, op9_secrets, op10_shingle_join)}


def oracle_sql() -> dict[str, str]:
    return {}
