"""Import of weighted phrases into a phrase-sorted corpus, and its export."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.scalars import ascii_lower
from lexiloom.plans.ranges import range_number

SCHEMA = "row_id long, weight long, phrase string, snippet string"
#: Fixed value: the grammar of a line. Groups: weight digits, phrase, snippet.
LINE = r"^[ \t\n\x0B\f\r]*(?:([0-9]+)(?:[^0-9\t][^\t]*)?|[^0-9 \t\n\x0B\f\r][^\t]*)\t[ \t\n\x0B\f\r]*([^ \t\n\x0B\f\r][^\t]*)(?:\t([\s\S]*))?\z"
MOST_WEIGHT, MOST_LINE = 2**31 - 1, 8191


def parse_columns(line: Column) -> dict[str, Column]:
    """weight, phrase and snippet of a line; the phrase is empty where the line has none."""
    digits = F.regexp_extract(line, LINE, 1)
    return {
        "weight": F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.try_cast("long")),
        "phrase": ascii_lower(F.regexp_extract(line, LINE, 2)),
        "snippet": F.regexp_extract(line, LINE, 3),
    }


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line_no from 0, value) of a text file, or of the files of a folder in the order of their names; only line
    feeds end lines. Numbers come from counts per file split, so that no task sees all lines."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    raw = spark.read.option("lineSep", "\n").text(path).select("value", at.alias("at"), F.monotonically_increasing_id().alias("mid"))
    per = raw.groupBy("at").agg(F.count("*").alias("n"), F.min("mid").alias("mid0"))
    per = per.withColumn("before", F.sum("n").over(Window.orderBy("at")) - F.col("n"))  # one row a split
    return raw.join(per.select("at", "mid0", "before"), "at").select((F.col("before") + F.col("mid") - F.col("mid0")).alias("line_no"), "value")


def parse(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of SCHEMA from (line_no, value). `limit` counts lines before any is dropped; below 0: none. Lines
    without a phrase go, and so do those that quarantined() gives."""
    if limit is not None and limit >= 0:
        lines = lines.where(F.col("line_no") < limit)
    return _parsed(lines).where("phrase <> '' and not odd").select(F.col("line_no").alias("row_id"), "weight", "phrase", "snippet")


def quarantined(lines: DataFrame) -> DataFrame:
    """Lines that have no defined meaning: weights beyond 31 bits, and 8191 bytes or more."""
    return _parsed(lines).where("odd").select("line_no", "value")


def _parsed(lines: DataFrame) -> DataFrame:
    out = lines.select("line_no", "value", *(c.alias(k) for k, c in parse_columns(F.col("value")).items()))
    return out.withColumn("odd", (F.col("phrase") != "") & (F.coalesce(F.col("weight") > MOST_WEIGHT, F.lit(True)) | (F.octet_length("value") >= MOST_LINE)))


def counts(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """One row (n_lines, n_added)."""
    if limit is not None and limit >= 0:
        lines = lines.where(F.col("line_no") < limit)
    return _parsed(lines).agg(F.count("*").alias("n_lines"), F.count_if((F.col("phrase") != "") & ~F.col("odd")).alias("n_added"))


def is_sorted(lines: DataFrame) -> DataFrame:
    """One row (is_sorted): whether phrases, empty ones included, never fall in line order. Neighbours are compared
    inside ranges of lines, and the first of each range with the last of the one before."""
    rows = _parsed(lines).select("line_no", "phrase").withColumn("part", F.floor(F.col("line_no") / 65536))
    order = Window.partitionBy("part").orderBy("line_no")
    inside = rows.withColumn("ok", F.coalesce(F.lag("phrase").over(order) <= F.col("phrase"), F.lit(True)))
    ends = inside.groupBy("part").agg(F.min_by("phrase", "line_no").alias("head"), F.max_by("phrase", "line_no").alias("tail"), F.bool_and("ok").alias("ok"))
    ends = ends.withColumn("ok", F.col("ok") & F.coalesce(F.lag("tail").over(Window.orderBy("part")) <= F.col("head"), F.lit(True)))
    return ends.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("is_sorted"))


def with_index(corpus: DataFrame, partitions: int | None = None) -> DataFrame:
    """The corpus in phrase order with idx, its place from 0: ranges are sorted apart and offset by the sizes of
    those before, so no task sees the whole corpus."""
    spread = corpus.withColumn("part", range_number(corpus, ["phrase", "row_id"], partitions))
    per = spread.groupBy("part").agg(F.count("*").alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("phrase", "row_id"))
    return spread.withColumn("rank", rank).join(per, "part").select((F.col("before") + F.col("rank") - 1).alias("idx"), *corpus.columns)


def write(corpus: DataFrame, path: str) -> None:
    """Write sorted by phrase, so that a prefix filter skips row groups."""
    corpus.repartitionByRange("phrase", "row_id").sortWithinPartitions("phrase", "row_id").write.mode("overwrite").parquet(path)


def export_lines(corpus: DataFrame) -> DataFrame:
    """Rows (row_id, phrase, line): weight, tab, phrase, tab, snippet, with the tab also before an empty snippet."""
    return corpus.select("row_id", "phrase", F.concat(F.col("weight").cast("string"), F.lit("\t"), "phrase", F.lit("\t"), "snippet").alias("line"))


#: A file that marks a folder as an export, so that only such a folder is ever replaced.
MARK = "_exported_lines"


def export(corpus: DataFrame | None, path: str, single: bool = False, spark: SparkSession | None = None) -> None:
    """Write the lines in phrase order: a folder of text files whose names keep the order, or one file with their bytes
    one after the other. All is written beside and then moved; without a corpus there are no lines. Only a file, or a
    folder that an export has made, is replaced; any other folder raises FileExistsError and is left alone."""
    spark = spark or corpus.sparkSession
    java, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    here, beside = java.Path(path), java.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    fs = here.getFileSystem(conf)
    replaced = fs.exists(here)
    if replaced and fs.getFileStatus(here).isDirectory() and not fs.exists(java.Path(here, MARK)):
        raise FileExistsError(f"{path} is a folder that no export has made")
    lines = export_lines(corpus).repartitionByRange("phrase", "row_id").sortWithinPartitions("phrase", "row_id").select("line") if corpus is not None else spark.createDataFrame([], "line string")
    lines.write.text(beside.toString())
    if single:
        parts, beside = beside, java.Path(f"{beside}.one")
        out = fs.create(beside)
        try:
            for name in sorted(f.getPath().getName() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-")):
                taken = fs.open(java.Path(parts, name))
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(taken, out, conf, False)
                taken.close()
        finally:
            out.close()
        fs.delete(parts, True)
    else:
        fs.create(java.Path(beside, MARK)).close()
    if replaced:
        fs.delete(here, fs.getFileStatus(here).isDirectory())
    if not fs.rename(beside, here):
        raise OSError(f"the export stays at {beside}, as it could not be moved to {path}")


def size_in_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of the files of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
