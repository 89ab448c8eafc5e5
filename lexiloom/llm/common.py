"""What the operators of this package share: the shared folder, text buffers, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, as texts may be long, and this package on the workers' path."""
    if int(spark.conf.get(ARROW_ROWS, "10000")) > 1000:
        spark.conf.set(ARROW_ROWS, "1000")
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark, "_lexiloom_shipped", False):
        return
    packed = Path(tempfile.mkdtemp()) / "lexiloom.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted((ROOT / "lexiloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(packed))
    spark._lexiloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all runs in
    one process, as in tests. Elsewhere other machines could not read it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_lexiloom_dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = spark._lexiloom_dir = f"file://{tempfile.mkdtemp(prefix='lexiloom-')}"
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the shared folder, in a folder for each value of the columns `by`, and read it back,
    which cuts the lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame, only: str = "") -> None:
    """Remove tables made by materialize() that no later plan reads; or only their folder of this name (column=value)."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{df._written_at}/{only}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Collect the plans, broadcast tables and shuffles that are no longer referenced, on both sides of the driver. Loops
    of many plans call it each time, as the driver's heap otherwise grows up to its limit before Java looks for garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced."""
    import time

    for _ in range(2):  # the cleaner works in the background
        release(spark)
        time.sleep(0.5)


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off and len(col) else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000):
    """Parts of a batch whose texts have about `limit` bytes together; a longer text stands alone."""
    _, off = text_buffer(batch.column(column))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + limit, "right")) - 1)
        yield batch.slice(begin, min(end, n) - begin)
        begin = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b: long): rows (vertex, component), component the smallest vertex.

    Alternating large-star and small-star steps, each two aggregations and two joins; a vertex with
    many links is only ever reduced by min(), never gathered. Vertices without links are absent.
    No edges: no rows.
    """
    spark = edges.sparkSession
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(pair(edges), name)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = pair(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        star = star.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = materialize(pair(star), name)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        release(spark)
        if seen == state or not seen[0]:
            break
        state = seen
    mine = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return mine.unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
