"""Order and choice: hash order instead of a seeded shuffle, quotas, remainders, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key: Column, seed: int, epoch: int = 0) -> Column:
    """An order that seed, epoch and key alone decide, on every engine and partitioning."""
    return F.sha1(F.concat(F.lit(f"{seed}:{epoch}:"), key.cast("string")).cast("binary"))


def subset(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in hash order: a top-k, not a full sort."""
    return rows.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def quota(n: Column, world: int, rank: int) -> Column:
    return F.floor(n / world) + F.when(F.lit(rank) < n % world, 1).otherwise(0)


def drop_remainder(rows: DataFrame, place: str, total: Column, world: int) -> DataFrame:
    """Rows whose place from 0 is below the largest multiple of ``world``."""
    return rows.where(F.col(place) < total - total % world)


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first in order."""
    return rows.withColumn(
        "__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)),
    ).where("__n = 1").drop("__n")


def zip_rows(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Rows of equal place side by side; different numbers of rows are an error, found when the result is computed."""
    whole = F.when(
        F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("the two sides differ in length")),
    ).otherwise(F.lit(True))
    marked = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), order, "full_outer")
    return marked.where(whole).drop("__a", "__b")
