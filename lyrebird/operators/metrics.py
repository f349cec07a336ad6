"""Evaluation: error rates with their three denominators, two-level reports, comparison of systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import rate


def corpus_rate(rows: DataFrame, errors: str, tokens: str, group: list[str] | None = None) -> DataFrame:
    """Sum of errors over sum of reference tokens, 0 without tokens."""
    return rows.groupBy(*(group or [])).agg(
        F.sum(errors).cast("long").alias("errors"), F.sum(tokens).cast("long").alias("tokens"),
        rate(F.sum(errors), F.sum(tokens)).alias("rate"),
    )


def floored_rate(rows: DataFrame, errors: str, tokens: str, group: list[str] | None = None) -> DataFrame:
    """Every row counts one token at least; 0 without rows."""
    floor = F.greatest(F.lit(1), F.col(tokens))
    return rows.groupBy(*(group or [])).agg(
        F.coalesce(F.sum(errors) / F.greatest(F.lit(1), F.sum(floor)), F.lit(0.0)).alias("rate")
    )


def exact_match(rows: DataFrame, reference: Column, hypothesis: Column, group: list[str]) -> DataFrame:
    return rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg((reference == hypothesis).cast("double")).alias("exact_match"),
    )


def two_level(rows: DataFrame, bucket: str, sums: dict[str, str], rates: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for all and one for each bucket: samples, sums, and ratios of sums. One pass by grouping sets."""
    aggs = [F.sum(c).alias(n) for n, c in sums.items()]
    both = rows.groupingSets([[bucket], []], bucket).agg(
        F.count("*").alias("n"), *aggs, F.grouping(bucket).alias("__g"),
    )
    named = F.when(F.col("__g") == 1, F.lit("overall")).otherwise(F.col(bucket)).alias(bucket)
    return both.select(named, "n", *sums, *[rate(F.col(e), F.col(t)).alias(n) for n, (e, t) in rates.items()])


def length_ratio(rows: DataFrame, predicted: Column, reference: Column, collapsed_at: float = 0.3) -> DataFrame:
    """Mean ratio of lengths, and the share of rows at or below ``collapsed_at``."""
    ratio = predicted / F.greatest(F.lit(1), reference)
    return rows.agg(
        F.count("*").alias("n"), F.avg(ratio).alias("mean_ratio"),
        F.avg((ratio <= collapsed_at).cast("double")).alias("collapsed_ratio"),
    )


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order."""
    return rows.withColumn(
        "__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())),
    ).where("__n = 1").drop("__n")


def compare(
    a: DataFrame, b: DataFrame, key: str, errors: str, tokens: str, prediction: str | None = None,
    names: tuple[str, str] = ("a", "b"), tie: float = 1e-9, margin: float = 0.01,
) -> DataFrame:
    """One row on a baseline and a candidate with one row for each key: token errors over all rows of each (every row
    counts one token at least), changes over shared keys, and a verdict."""
    side = lambda df, x: df.select(
        key, (F.col(errors) / F.greatest(F.lit(1), F.col(tokens))).alias(f"__{x}"),
        (F.col(prediction) if prediction else F.lit(None)).alias(f"__p{x}"),
    )
    d = F.col("__b") - F.col("__a")
    changed = F.count_if(~F.col("__pa").eqNullSafe(F.col("__pb")))
    shared = side(a, "a").join(side(b, "b"), key).agg(
        F.count("*").alias("shared"), changed.alias("changed"), F.count_if(d < -tie).alias("improved"), F.count_if(d > tie).alias("worsened"), F.count_if(F.abs(d) <= tie).alias("unchanged")
    )
    rates = floored_rate(a, errors, tokens).toDF("rate_a").crossJoin(
        F.broadcast(floored_rate(b, errors, tokens).toDF("rate_b"))
    )
    gap = F.col("rate_b") - F.col("rate_a")
    # The wording of the three verdicts.
    better = f"{names[1]} improved preview token error vs {names[0]}"
    worse = f"{names[0]} remained better than {names[1]} on preview token error"
    neutral = f"{names[0]} and {names[1]} were roughly neutral on preview token error"
    verdict = F.when(gap < -margin, better).when(gap > margin, worse).when(gap.isNotNull(), neutral).otherwise("comparison unavailable")
    return rates.crossJoin(F.broadcast(shared)).select(
        "rate_a", "rate_b", "shared", "changed", "improved", "worsened", "unchanged", verdict.alias("verdict"),
    )


def real_time_factor(rows: DataFrame, elapsed: str, audio: str) -> DataFrame:
    return rows.agg(
        (F.sum(elapsed) / F.greatest(F.lit(1e-6), F.sum(audio))).alias("rtf"),
        (F.sum(audio) / 3600).alias("audio_hours"),
    )


def weighted_mean(rows: DataFrame, value: str, weight: str, group: list[str] | None = None) -> DataFrame:
    """Mean by weight; NaN without any."""
    total = F.sum(weight)
    return rows.groupBy(*(group or [])).agg(
        F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.lit(float("nan"))).alias("mean"),
        total.alias("weight"),
    )


def preview_stats(lines: DataFrame, values: Column, group: list[str], ratio_at: float = 0.3) -> DataFrame:
    """Means over the lines that have a value; shares over all lines. ``values`` is a map of key=value pairs."""
    m = lines.withColumn("__m", values)
    pred, ref = F.col("__m")["pred_tok"], F.col("__m")["ref_tok"]
    ratio = F.when(ref > 0, pred / ref)
    return m.groupBy(*group).agg(
        F.count("*").alias("lines"), F.avg(ratio).alias("mean_ratio"), F.avg(F.col("__m")["blank_top1"]).alias("mean_blank_top1"), F.avg(F.col("__m")["avg_blank"]).alias("mean_avg_blank"),
        (F.count_if(ratio <= ratio_at) / F.count("*")).alias("collapsed_ratio"),
    )


def mode_report(rows: DataFrame, mode: str, errors: str, tokens: str) -> DataFrame:
    """(mode, token_error_rate, exact_match, num_utts): one row for each decoding mode, from a row for each utterance with
    its edits and reference tokens. An utterance without edits is exact."""
    exact = F.avg((F.col(errors) == 0).cast("double"))
    return rows.groupBy(mode).agg(
        rate(F.sum(errors), F.sum(tokens)).alias("token_error_rate"), exact.alias("exact_match"),
        F.count("*").cast("double").alias("num_utts"),
    )
