"""Feature statistics: sums by dimension, moments, normalisation, exact quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cmvn_sums(rows: DataFrame, vector: str) -> DataFrame:
    """(dim, mean_stat, var_stat, frame_num): sums and sums of squares in double precision. Rows are exploded into
    dimensions and combined in the same task, so each task shuffles as many rows as there are dimensions."""
    x = F.col("x").cast("double")
    return rows.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(
        F.sum(x).alias("mean_stat"), F.sum(x * x).alias("var_stat"), F.count("x").alias("frame_num"),
    )


def cmvn_document(sums: DataFrame) -> DataFrame:
    """One row with the arrays that a statistics file holds."""
    listed = sums.agg(
        F.array_sort(F.collect_list(F.struct("dim", "mean_stat", "var_stat"))).alias("s"),
        F.max("frame_num").alias("frame_num"),
    )
    return listed.select(
        F.transform("s", lambda v: v["mean_stat"]).alias("mean_stat"),
        F.transform("s", lambda v: v["var_stat"]).alias("var_stat"), "frame_num",
    )


def cmvn_moments(sums: DataFrame, floor: float = 1e-20) -> DataFrame:
    """(dim, mean, var, istd): population moments, the variance no lower than ``floor``."""
    mean = F.col("mean_stat") / F.col("frame_num")
    var = F.greatest(F.col("var_stat") / F.col("frame_num") - mean * mean, F.lit(floor))
    return sums.select("dim", mean.alias("mean"), var.alias("var"), (1 / F.sqrt(var)).alias("istd"))


def cmvn_apply(rows: DataFrame, vector: str, moments: DataFrame, name: str = "normalized") -> DataFrame:
    """Rows with the normalised vector. The moments are one row of two arrays."""
    from ..functions.maths import normalize

    listed = moments.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "istd"))).alias("m"))
    arrays = listed.select(
        F.transform("m", lambda v: v["mean"]).alias("__mean"), F.transform("m", lambda v: v["istd"]).alias("__istd"),
    )
    return rows.crossJoin(F.broadcast(arrays)).withColumn(
        name, normalize(F.col(vector), F.col("__mean"), F.col("__istd")),
    ).drop("__mean", "__istd")


def quantiles(rows: DataFrame, group: list[str], value: str, qs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(group, n, mean, one column for each of qs): nearest rank at round_half_even((n - 1) q), exact. Without groups and
    without rows all are 0.

    No task sorts a group: approximate quantiles close to either side of the wanted ones cut it into bins, whose
    sizes tell which bin holds a wanted rank, and only the distinct values of those bins are put in order. How far
    off the approximation is changes the size of the bins, not the result.
    """
    v = F.col(value).cast("double")
    given = rows.where(F.col(value).isNotNull()).select(*group, v.alias("__v"))
    around = sorted({min(1.0, max(0.0, q + x / accuracy)) for q in qs.values() for x in (-2, 2)})
    cuts = F.percentile_approx("__v", around, accuracy).alias("__cuts")
    stats = given.groupBy(*group).agg(F.count("*").alias("n"), F.coalesce(F.avg("__v"), F.lit(0.0)).alias("mean"), cuts)
    bin_of = F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))
    sides = stats.select(*group, "__cuts")
    binned = (
        given.join(sides, group) if group else given.crossJoin(F.broadcast(sides))
    ).select(*group, "__v", bin_of.alias("__b"))
    values = binned.groupBy(*group, "__b", "__v").agg(F.count("*").alias("__c"))
    coarse = values.groupBy(*group, "__b").agg(F.sum("__c").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*group).orderBy("__b"))
    spans = coarse.select(*group, "__b", (upto - F.col("__c")).alias("__from"), upto.alias("__to"))
    ranks = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("k"), F.rint((F.col("n") - 1) * q).cast("long").alias("r"),
                ) for k, q in qs.items()
            ]
        )
    ).alias("__q")
    wanted = stats.select(*group, ranks).select(*group, F.col("__q.k").alias("__k"), F.col("__q.r").alias("__r"))
    hit = wanted.join(spans, group) if group else wanted.crossJoin(F.broadcast(spans))
    hit = hit.where((F.col("__r") >= F.col("__from")) & (F.col("__r") < F.col("__to"))).select(
        *group, "__b", "__k", (F.col("__r") - F.col("__from")).alias("__r"),
    )
    fine_to = F.sum("__c").over(Window.partitionBy(*group, "__b").orderBy("__v"))
    fine = values.join(hit.select(*group, "__b").distinct(), [*group, "__b"], "left_semi").select(
        *group, "__b", "__v", (fine_to - F.col("__c")).alias("__from"), fine_to.alias("__to"),
    )
    found = hit.join(fine, [*group, "__b"]).where((F.col("__r") >= F.col("__from")) & (F.col("__r") < F.col("__to")))
    wide = found.groupBy(*group).agg(
        *[F.coalesce(F.max(F.when(F.col("__k") == k, F.col("__v"))), F.lit(0.0)).alias(k) for k in qs]
    )
    base = stats.select(*group, "n", "mean")
    return base.join(wide, group) if group else base.crossJoin(F.broadcast(wide))
