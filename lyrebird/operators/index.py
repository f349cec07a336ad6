"""Indexes of sharded samples: pairing, split counts, length summaries, bucket parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import bucket_id
from ..functions.splits import HashSplit


def with_split(rows: DataFrame, rule: HashSplit, sample: str, shard: str, name: str = "split") -> DataFrame:
    return rows.withColumn(name, rule.side(rule.key(F.col(sample), F.col(shard))))


def pair_members(audio: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Samples that have both members; what has no partner is dropped. Keys must be unique on each side."""
    return audio.join(meta, keys)


def unpaired(members: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return members.join(others, keys, "left_anti")


def pair_in_order(members: DataFrame, shard: str, key: str, kind: str, order: str) -> DataFrame:
    """(shard, key, pair, audio_at, json_at) where keys may repeat, as a scan of each shard would pair them: a member
    pairs with the last waiting one of the other kind, both then leave; a later member of the same kind takes the place
    of a waiting one. ``kind`` is ``audio`` or ``json``; ``order`` is the place in the shard.

    Within a key, members between two pairs are of one kind, so a pair closes at every change of kind that does
    not directly follow a pair: runs of equal kinds are numbered, and a run's first member pairs with the member
    before it unless that one was itself taken.
    """
    w = Window.partitionBy(shard, key).orderBy(order)
    marked = members.select(
        shard, key, kind, order, F.lag(kind).over(w).alias("__last"), F.lag(order).over(w).alias("__prev"),
    )
    changes = marked.withColumn(
        "__change", (F.col("__last").isNotNull() & (F.col("__last") != F.col(kind))).cast("int"),
    )
    # The length of the unbroken row of changes up to a member: odd places close a pair, even ones wait.
    rows = changes.withColumn("__block", F.sum(1 - F.col("__change")).over(w))
    streak = F.sum("__change").over(Window.partitionBy(shard, key, "__block").orderBy(order))
    closed = rows.withColumn("__streak", streak).where((F.col("__change") == 1) & (F.col("__streak") % 2 == 1))
    audio = F.when(F.col(kind) == "audio", F.col(order)).otherwise(F.col("__prev"))
    meta = F.when(F.col(kind) == "json", F.col(order)).otherwise(F.col("__prev"))
    return closed.select(
        shard, key, F.row_number().over(w).alias("pair"), audio.alias("audio_at"), meta.alias("json_at"),
    )


def split_counts(rows: DataFrame, shard: str, rule: HashSplit, split: str = "split") -> DataFrame:
    """One row for each shard: samples, samples of each split (zeros appear), and the shard's own split."""
    each = [F.count_if(F.col(split) == side).alias(f"num_{side}") for side in rule.sides]
    return rows.groupBy(shard).agg(F.count("*").alias("num_samples"), *each).withColumn(
        "assigned_split", rule.side(F.col(shard)),
    )


def split_totals(rows: DataFrame, split: str = "split") -> DataFrame:
    """(split, num_samples) with a row for all under the name ``all``."""
    return rows.groupingSets([[split], []], split).agg(F.count("*").alias("num_samples"), F.grouping(split).alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col(split)).alias("split"), "num_samples")


def length_summary(rows: DataFrame, frames: str) -> DataFrame:
    return rows.agg(
        F.count("*").alias("num_samples"), F.coalesce(F.min(frames), F.lit(0)).alias("min_frames"),
        F.coalesce(F.max(frames), F.lit(0)).alias("max_frames"),
    )


def frame_histogram(rows: DataFrame, frames: str, width: int = 80) -> DataFrame:
    return rows.groupBy(bucket_id(F.col(frames), width).alias("bucket_id")).agg(F.count("*").alias("num_samples"))


def summary_document(rows: DataFrame, frames: str, split: str, width: int = 80) -> DataFrame:
    """One row: counts, extremes, counts by split, and the histogram as a map."""
    # One pass: counts by (split, bucket) are few rows whatever the number of samples.
    cells = rows.groupBy(split, bucket_id(F.col(frames), width).alias("b")).agg(
        F.count("*").alias("n"), F.min(frames).alias("lo"), F.max(frames).alias("hi"),
    )
    by_split = cells.groupBy(split).agg(F.sum("n").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(split, "n")))).alias("split_counts")
    )
    by_bucket = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("b", "n"))), lambda x: F.struct(x["b"].cast("string"), x["n"])
            )
        ).alias("frame_buckets")
    )
    total = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_samples"), F.coalesce(F.min("lo"), F.lit(0)).alias("min_frames"),
        F.coalesce(F.max("hi"), F.lit(0)).alias("max_frames"),
    )
    return total.crossJoin(F.broadcast(by_split)).crossJoin(F.broadcast(by_bucket)).withColumn("version", F.lit(2))


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def bucket_parts(
    rows: DataFrame, group: list[str], order: list[Column], shard: str, entries_per_part: int,
) -> DataFrame:
    """One row for each part of a bucket: samples, first and last shard."""
    part = numbered(rows, group, order).withColumn("part", F.floor(F.col("ordinal") / entries_per_part).cast("long"))
    return part.groupBy(*group, "part").agg(
        F.count("*").alias("num_samples"), F.min_by(shard, "ordinal").alias("first_shard"),
        F.max_by(shard, "ordinal").alias("last_shard"),
    )


def union_roots(*roots: DataFrame, shard: str = "shard_name") -> DataFrame:
    """Several roots as one; a shard name in two roots is an error, found when the result is computed."""
    named = [r.withColumn("__root", F.lit(i)) for i, r in enumerate(roots)]
    out = named[0]
    for r in named[1:]:
        out = out.unionByName(r)
    clash = out.groupBy(shard).agg(F.count_distinct("__root").alias("n")).where("n > 1").agg(F.count("*").alias("n"))
    checked = clash.select(
        F.when(
            F.col("n") > 0, F.raise_error(F.lit("a shard name occurs in two roots")),
        ).otherwise(F.lit(True)).alias("__ok")
    )
    return out.drop("__root").crossJoin(F.broadcast(checked)).where("__ok").drop("__ok")
