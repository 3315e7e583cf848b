"""Vector arithmetic on array columns, in double, inside the JVM.

Null vectors or vectors with a null element give null; vectors of unequal length are treated as of no similarity (null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2, between 0 and 1: the scale of search results."""
    return (F.lit(1.0) + cosine(a, b)) / 2


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str, unit: bool = True, name: str = "centroid") -> DataFrame:
    """(keys, name): the elementwise mean of each group, of unit length if ``unit``. The mean is taken per axis with
    partial sums in the map tasks; only one row per group and axis is shuffled."""
    axes = df.filter(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("axis", "x"))
    means = axes.groupBy(*keys, "axis").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "x"))), lambda s: s["x"]).alias(name))
    return whole.withColumn(name, normalised(F.col(name))) if unit else whole
