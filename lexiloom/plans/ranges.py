"""Range numbers that are the same wherever they are computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 128


def range_number(df: DataFrame, keys: list[str], n: int | None = None) -> Column:
    """The number of a row's range in the order of keys. Ranges are cut at rows of a sample whose size is bounded
    (16 a range, those that hash lowest), so every plan that uses the column agrees, unlike the number of a task."""
    n = min(MOST, n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = sorted(tuple(r) for r in df.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(16 * n).collect())
    cuts = sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []
    if not cuts:
        return F.lit(0)
    row = F.struct(*keys)
    types = {f.name: f.dataType for f in df.schema}
    point = lambda cut: F.struct(*(F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, cut, strict=True)))
    return F.size(F.filter(F.array(*map(point, cuts)), lambda c: c <= row))
