"""Batch planning: fixed, greedy and budgeted batches, statistics, steps, ranks.

Greedy batches over lengths in order look sequential, row by row. But rows of equal length are alike, so the
plan is folded over the histogram of lengths (a few thousand rows for each group, however many samples), and
each sample's batch follows from its place among the samples of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def places(rows: DataFrame, group: list[str], frames: str, tie: list[str]) -> DataFrame:
    """Rows with ``place``: the place from 0 in the order (frames, tie) of the group. Rows are numbered among those of
    equal length, and moved by the histogram: no window holds a whole group."""
    keys = [*group, frames]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = counts.select(
        *keys,
        F.coalesce(
            F.sum("__n").over(Window.partitionBy(*group).orderBy(frames).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__before"),
    )
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*tie)) - 1
    return rows.withColumn("__own", own).join(before, keys).withColumn(
        "place", F.col("__before") + F.col("__own"),
    ).drop("__before", "__own")


def fixed_batches(rows: DataFrame, group: list[str], frames: str, tie: list[str], size: int) -> DataFrame:
    return places(rows, group, frames, tie).withColumn("batch", F.floor(F.col("place") / size).cast("long"))


def greedy_batches(
    rows: DataFrame, group: list[str], frames: str, tie: list[str], most: int, budget: int | None, world: int = 1,
) -> DataFrame:
    """Rows with ``batch``, in the order (frames, tie) of each group: a batch takes the next row while it has at most
    ``most`` rows and rows x longest stay within ``budget``; one row is always taken. With ``world`` devices a batch
    grows by ``world`` rows at a time, limits hold for each device, and the remainder below ``world`` is left out."""
    if world > 1:
        ranked = places(rows, group, frames, tie).withColumn("__unit", F.floor(F.col("place") / world))
        units = ranked.groupBy(*group, "__unit").agg(
            F.max(frames).alias("__f"), F.count("*").alias("__c"),
        ).where(F.col("__c") == world)
        planned = greedy_batches(units.drop("__c"), group, "__f", ["__unit"], most, budget)
        return ranked.join(planned.select(*group, "__unit", "batch"), [*group, "__unit"]).drop("__unit", "place")
    limit = budget if budget and budget > 0 else None
    runs = rows.groupBy(*group, F.col(frames).alias("__f")).agg(F.count("*").alias("__c"))
    listed = runs.groupBy(*group).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("__f").cast("long").alias("f"), F.col("__c").alias("c")))
        ).alias("__runs")
    )
    long = lambda x: F.lit(x).cast("long")
    fits = lambda f: F.least(
        long(most), F.floor(long(limit) / F.greatest(f, long(1))),
    ) if limit else long(most)

    def step(state: Column, run: Column) -> Column:
        """state: the batch that is open (-1 none), its rows, and the runs done. Of a run, ``room`` rows go into the
        open batch, the others into batches of ``size``."""
        batch, held = state["batch"], state["held"]
        size = F.greatest(long(1), fits(run["f"]))
        room = F.when(batch < 0, long(0)).otherwise(F.least(run["c"], F.greatest(long(0), fits(run["f"]) - held)))
        rest = run["c"] - room
        full = F.floor((rest - 1) / size)
        done = F.struct(run["f"].alias("f"), batch.alias("batch"), room.alias("room"), size.alias("size"))
        return F.struct(
            F.when(rest > 0, batch + 1 + full).otherwise(batch).alias("batch"),
            F.when(rest > 0, rest - full * size).otherwise(held + room).alias("held"),
            F.concat(state["done"], F.array(done)).alias("done"),
        )

    start = F.struct(
        long(-1).alias("batch"), long(0).alias("held"),
        F.expr("CAST(array() AS array<struct<f:bigint,batch:bigint,room:bigint,size:bigint>>)").alias("done"),
    )
    plan = listed.select(*group, F.explode(F.aggregate("__runs", start, step)["done"]).alias("__p")).select(
        *group, F.col("__p.f").alias("__pf"), F.col("__p.batch").alias("__b"), F.col("__p.room").alias("__room"),
        F.col("__p.size").alias("__size"),
    )
    own = F.row_number().over(Window.partitionBy(*group, frames).orderBy(*tie)) - 1
    named = plan.withColumnRenamed("__pf", frames)
    batch = F.when(F.col("__own") < F.col("__room"), F.col("__b")).otherwise(
        F.col("__b") + 1 + F.floor((F.col("__own") - F.col("__room")) / F.col("__size"))
    )
    return rows.withColumn("__own", own).withColumn(
        frames, F.col(frames).cast("long"),
    ).join(named, [*group, frames]).withColumn("batch", batch.cast("long")).drop("__own", "__b", "__room", "__size")


class Batcher:
    """The greedy batcher as a fold: its state is (batch, samples held, their longest, their text). ``extra`` text tokens
    come with each sample; padded text counts as samples times the longest text, else it is summed."""

    def __init__(
        self, budget: int | None, most: int | None, skip_oversized: bool = True, padded_text: bool = False,
        extra: int = 0,
    ):
        self.budget, self.most, self.skip, self.padded, self.extra = budget or None, most or None, skip_oversized, padded_text, extra

    def step(
        self, state: tuple[int, int, int, int], frames: int, text: int,
    ) -> tuple[tuple[int, int, int, int], int | None]:
        """The next state, and the sample's batch (none if it is skipped)."""
        batch, n, longest, words = state
        over = self.budget is not None and frames + text + (self.extra if self.padded else 0) > self.budget
        if over and self.skip:
            return state, None
        told = (n + 1) * (max(words, text) + self.extra) if self.padded else words + text
        total = (n + 1) * max(longest, frames) + told
        if n and (self.most is not None and n >= self.most or self.budget is not None and total > self.budget):
            batch, n, longest, words = batch + 1, 0, 0, 0
        if over:
            return (batch + 1, 0, 0, 0), batch
        return (batch, n + 1, max(longest, frames), max(words, text) if self.padded else words + text), batch


def token_split(
    rows: DataFrame, group: list[str], order: list[str], frames: str, text: str, budget: int, most: int | None = None,
    skip_oversized: bool = True, padded_text: bool = False, extra: int = 0,
) -> DataFrame:
    """(group, order, frames, text, batch): samples in their given order, cut when rows x longest plus text would pass the
    budget. Oversized samples are skipped (no row) or stand alone. Where a batch ends depends on all before it, so a
    group is folded in one task; rows come sorted from the shuffle and pass through one Arrow batch at a time."""
    batcher = Batcher(budget if budget > 0 else None, most, skip_oversized, padded_text, extra)
    typed = rows.select(*group, *order, F.col(frames).cast("long").alias(frames), F.col(text).cast("long").alias(text))
    dealt = typed.repartition(*group) if group else typed.coalesce(1)
    width = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, (0, 0, 0, 0)
        for part in batches:
            columns = [part.column(i).to_pylist() for i in (*range(width), part.num_columns - 2, part.num_columns - 1)]
            kept, numbers = [], []
            for i, (*key, f, t) in enumerate(zip(*columns)):
                if key != held:
                    held, state = key, (0, 0, 0, 0)
                state, batch = batcher.step(state, f, t)
                if batch is not None:
                    kept.append(i), numbers.append(batch)
            taken = part.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(numbers, pa.int64())], names=[*part.schema.names, "batch"],
            )

    return dealt.sortWithinPartitions(*group, *order).mapInArrow(
        run, typed.withColumn("batch", F.lit(0).cast("long")).schema,
    )


def budget_prefix(
    rows: DataFrame, group: list[str], order: list[str], frames: str, text: str, budget: int | None,
    text_budget: int | None = None, extra: int = 0, padded_text: bool = False, skip_oversized: bool = True,
) -> DataFrame:
    """(group, selected, skipped, dropped): the longest prefix of each group within the budgets, its first sample always.
    Costs only grow along a group, so the prefix is a filter over cumulative windows. No budget is no limit."""
    f, t = F.col(frames), F.col(text)
    limit, text_limit = (x if x and x > 0 else None for x in (budget, text_budget))
    own = f + t + (extra if padded_text else 0)
    over = (own > limit) if limit else F.lit(False)
    if text_limit:
        over = over | (t + max(0, extra) > text_limit)
    marked = rows.withColumn("__skip", over & F.lit(skip_oversized))
    w = Window.partitionBy(*group, "__skip").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    n, longest, most_text, words = F.row_number().over(w), F.max(f).over(upto), F.max(t).over(upto), F.sum(t).over(upto)
    total = n * longest + (n * (most_text + max(0, extra)) if padded_text else words)
    beyond = (total > limit) if limit else F.lit(False)
    if text_limit:
        beyond = beyond | (n * (most_text + max(0, extra)) > text_limit)
    whole = Window.partitionBy(*group).orderBy(*order)
    skips = F.count_if("__skip").over(whole.rowsBetween(Window.unboundedPreceding, 0))
    cost = marked.select(
        *group, "__skip", n.alias("__n"), beyond.alias("__beyond"), F.row_number().over(whole).alias("__at"),
        skips.alias("__before"),
    )
    first = F.min(F.when(~F.col("__skip") & F.col("__beyond"), F.struct("__n", "__at", "__before")))
    agg = cost.groupBy(*group).agg(
        F.count("*").alias("__all"), F.count_if("__skip").alias("__skips"), first.alias("__first"),
        F.count_if(~F.col("__skip")).alias("__kept"),
    )
    # The reader stops at the sample that passes the budget; samples behind it are dropped, not skipped.
    alone = F.col("__first.__n") == 1
    stop = F.col("__first.__at")
    selected = F.when(stop.isNull(), F.col("__kept")).when(alone, F.lit(1)).otherwise(F.col("__first.__n") - 1)
    skipped = F.when(stop.isNull(), F.col("__skips")).otherwise(F.col("__first.__before"))
    dropped = F.when(stop.isNull(), F.lit(0)).when(alone, F.col("__all") - stop).otherwise(F.col("__all") - stop + 1)
    return agg.select(
        *group, selected.cast("long").alias("selected"), skipped.cast("long").alias("skipped"),
        dropped.cast("long").alias("dropped"),
    )


def batch_stats(rows: DataFrame, group: list[str], frames: str, text: str, extra: int = 0) -> DataFrame:
    """Sizes of batches: samples, longest and total frames and text, padded tokens, and the budgets they count against."""
    n, f, t = F.col("batch_size"), F.col("max_frames"), F.col("max_text")
    base = rows.groupBy(*group).agg(
        F.count("*").alias("batch_size"), F.max(frames).cast("long").alias("max_frames"), F.sum(frames).cast("long").alias("total_frames"), F.max(text).cast("long").alias("max_text"), F.sum(text).cast("long").alias("text_tokens")
    )
    return base.select(
        "*", (n * f).alias("padded_frames"), (n * t).alias("padded_text"), (n * f + n * t).alias("budget_tokens"), (n * f + F.col("text_tokens")).alias("total_tokens"),
        (
            n * f + n * t + n * max(0, extra)
        ).alias("effective_budget"), (n * (t + max(0, extra))).alias("effective_padded_text"),
    )


def steps(
    buckets: DataFrame, group: list[str], samples: str, local: Column, world: int, drop_last: bool = True,
) -> DataFrame:
    """(group, steps): batches over all buckets, one at least."""
    per = F.greatest(F.lit(1).cast("long"), local * max(1, world))
    each = F.floor(F.col(samples) / per) if drop_last else F.ceil(F.col(samples) / per)
    return buckets.groupBy(*group).agg(F.greatest(F.lit(1).cast("long"), F.sum(each)).cast("long").alias("steps"))


def rank_partition(shards: DataFrame, order: list[Column], world: int, workers: int) -> DataFrame:
    """Every shard's rank, and its worker within the rank, round robin. Shard lists are small: one window."""
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return shards.withColumn("__p", place).withColumn("rank", (F.col("__p") % world).cast("int")).withColumn(
        "worker", (F.floor(F.col("__p") / world) % workers).cast("int"),
    ).drop("__p")


def rank_slices(rows: DataFrame, place: str, size: int, world: int) -> DataFrame:
    """Rows with batch, rank and slot: each rank's equal part of each global batch of ``size``; the rows beyond a
    multiple of ``world`` in the last batch have no rank."""
    at = F.col(place)
    batch = F.floor(at / size).cast("long")
    whole = rows.withColumn("batch", batch)
    sizes = whole.groupBy("batch").agg((F.floor(F.count("*") / world)).cast("long").alias("__local"))
    inside = F.col(place) - F.col("batch") * size
    joined = whole.join(sizes, "batch")
    rank = F.when((F.col("__local") > 0) & (inside < F.col("__local") * world), F.floor(inside / F.col("__local")))
    return joined.withColumn("rank", rank.cast("int")).withColumn(
        "slot", F.when(F.col("rank").isNotNull(), inside - F.col("rank") * F.col("__local")).cast("long"),
    ).drop("__local")


def bucket_schedule(
    buckets: DataFrame, split: str, bucket: str, samples: str, width: int, most: int, budget: int | None, world: int,
    drop_last: bool = True, seed: int | None = None,
) -> DataFrame:
    """(split, bucket, step, local_batch, place): every bucket's steps; with a seed in an order by hash instead of bucket order."""
    from ..functions.frames import local_batch_size

    local = local_batch_size(F.col(bucket), width, most, budget)
    per = F.greatest(F.lit(1).cast("long"), local * world)
    n = F.floor(F.col(samples) / per) if drop_last else F.ceil(F.col(samples) / per)
    listed = buckets.withColumn("local_batch", local).withColumn("__n", n.cast("long")).where("__n > 0").withColumn(
        "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)),
    )
    order = [
        F.sha1(F.concat_ws(":", F.lit(seed), F.col(bucket), F.col("step")).cast("binary"))
    ] if seed is not None else [F.col(bucket), F.col("step")]
    return listed.select(
        split, bucket, "step", "local_batch",
        (F.row_number().over(Window.partitionBy(split).orderBy(*order)) - 1).alias("place"),
    )


def collate(rows: DataFrame, group: list[str], order: list[str], utt: str, frames: str, targets: str) -> DataFrame:
    """One row for each batch: ids, lengths, targets packed one after another, and the size they would be padded to."""
    item = F.struct(*order, F.col(utt).alias("u"), F.col(frames).alias("f"), F.col(targets).alias("y"))
    listed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("x"))
    pick = lambda c: F.transform("x", lambda v: v[c])
    return listed.select(
        *group, pick("u").alias("utt_ids"), pick("f").alias("feature_lengths"), F.flatten(pick("y")).alias("targets"),
        F.transform("x", lambda v: F.size(v["y"])).alias("target_lengths"), F.array_max(pick("f")).alias("padded_to"),
    )


def unpack(
    batches: DataFrame, group: list[str], targets: str = "targets", lengths: str = "target_lengths",
) -> DataFrame:
    """(group, place, offset, ids): packed targets by their running offsets."""
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    each = batches.select(*group, targets, lengths, ends.alias("__o")).select(
        *group, targets, "__o", F.posexplode(lengths).alias("place", "__n"),
    )
    return each.select(
        *group, "place", F.get("__o", F.col("place")).alias("offset"),
        F.slice(F.col(targets), F.get("__o", F.col("place")) + 1, F.col("__n")).alias("ids"),
    )


def truncate_prefix(batches: DataFrame, keep: int) -> DataFrame:
    """The first samples of collated batches, with targets and padding cut to them."""
    lengths = F.slice("target_lengths", 1, keep)
    features = F.slice("feature_lengths", 1, keep)
    total = F.aggregate(lengths, F.lit(0), lambda s, n: s + n)
    return batches.withColumns(
        {
            "targets": F.slice("targets", 1, total), "utt_ids": F.slice("utt_ids", 1, keep),
            "padded_to": F.array_max(features), "feature_lengths": features, "target_lengths": lengths,
        }
    )


def global_token_budget(ranks: DataFrame, step: str, tokens: str, peak: str, target_gib: float) -> DataFrame:
    """(step, tokens, peak, budget) from a row for each rank and step: the rank with the most bytes for a token decides."""
    from ..functions.frames import memory_token_budget

    own = F.greatest(F.lit(1), F.col(tokens))
    worst = ranks.groupBy(step).agg(F.max(F.col(peak) / own).alias("__ratio"), F.max(own).cast("long").alias("tokens"))
    told = worst.withColumn("peak", F.floor(F.col("__ratio") * F.col("tokens")).cast("long"))
    return told.select(
        step, "tokens", "peak", memory_token_budget(F.col("tokens"), F.col("peak"), target_gib).alias("budget"),
    )


def epoch_steps(
    source: str, batch: int, samples: int | None = None, buckets: DataFrame | None = None,
    lengths: DataFrame | None = None, budget: int | None = None, width: int = 80,
) -> int:
    """Batches of an epoch on one device by what a loader goes by: the rows (split's) of a bucket manifest, the frames of a
    length index, or the number of samples alone."""
    from ..functions.frames import local_batch_size

    if source == "buckets":
        planned = steps(buckets, [], "num_samples", local_batch_size(F.col("bucket_id"), width, batch, budget), 1)
        return int(planned.first()["steps"] or 1)
    if source == "lengths":
        frames = lengths.select(
            F.col("num_frames").cast("long").alias("num_frames"), F.monotonically_increasing_id().alias("__at"),
        )
        last = greedy_batches(
            frames, [], "num_frames", ["__at"], batch, budget,
        ).agg(F.max("batch").alias("last")).first()["last"]
        return 1 if last is None else int(last) + 1
    if samples is None:
        raise ValueError("without lengths the number of samples must be known")
    return max(1, -(-samples // batch))
