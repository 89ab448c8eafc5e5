"""The corpus pipeline: toxicity, n-gram Jaccard join, secret scans, source mix, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. run() writes each result as Parquet in
the shared folder and reads it again as the next one's documents, and then removes what it came from.

Defined results: an empty table gives no rows; repeated rows are judged like others, and equal ones with one
id become one at the second stage; columns that are not named here are carried along up to the last stage.
"""

from __future__ import annotations

from lexiloom.llm import bpe, common, credentials, fsjoin, mixing, toxicity


def drop_toxic(spark, docs, sf_dir):
    """The rows whose text scores below the threshold; a null or empty text is clean, a null doc_id is judged like others."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each group of near-duplicate texts; rows with a null id and rows without words all stay."""
    return fsjoin.keep_one(docs)


def hide_secrets(spark, docs, sf_dir):
    """All rows, found secrets replaced by a mark and n_chars counted anew; null texts stay null."""
    return credentials.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Each row as often as the mix takes it; rows without words are never taken, a null source is a source."""
    return mixing.mix(docs)


def encode(spark, docs, sf_dir):
    """Rows (doc_id, n_tokens, ids) of all rows; repeated rows repeat."""
    return bpe.encode(docs)


STAGES = [("toxicity", drop_toxic), ("shingle_join", drop_near_duplicates), ("secrets", hide_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: No SQL: the model, the automaton and the tokenizer are not expressible; tests/llm compare with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.discard(before)
        before = docs
    return docs
