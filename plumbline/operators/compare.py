"""Equality of query results, as bags and as lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows whose multiplicities differ: the columns of `left` and `surplus` (left less right).
    One grouping over the union; rows are equal where all columns are, NULL with NULL."""
    names = left.columns
    both = left.withColumn("surplus", F.lit(1).cast("bigint")).unionAll(right.toDF(*names).withColumn("surplus", F.lit(-1).cast("bigint")))
    return both.groupBy(*names).agg(F.sum("surplus").alias("surplus")).filter(F.col("surplus") != 0)


def _numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*(order or [F.lit(1)]))))


def list_difference(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], keys: list[str] = (), values: list[str] | None = None) -> DataFrame:
    """keys and `__n` of the places at which two lists differ. Both have columns of the same names."""
    keys, values = list(keys), values or [c for c in left.columns if c not in keys]
    a = _numbered(left, keys, left_order).select(*keys, "__n", F.struct(*values).alias("__a"))
    b = _numbered(right, keys, right_order).select(*[F.col(k).alias(f"__b{k}") for k in keys], F.col("__n").alias("__bn"), F.struct(*values).alias("__b"))
    test = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__b{k}")) for k in keys] + [F.col("__n") == F.col("__bn")])
    differs = a.join(b, test, "full").filter(F.col("__a").isNull() | F.col("__b").isNull() | ~F.col("__a").eqNullSafe(F.col("__b")))
    return differs.select(*[F.coalesce(F.col(k), F.col(f"__b{k}")).alias(k) for k in keys], F.coalesce("__n", "__bn").alias("__n"))
