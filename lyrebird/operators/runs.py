"""Runs: checkpoint leaderboards, trends, status, pruning, best epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(rows: DataFrame, group: list[str], loss: str, step: str, k: int) -> DataFrame:
    """The k best of each group by (loss, step), with ``place`` from 1; NaN last."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(loss).asc_nulls_last(), step))
    return rows.withColumn("place", place).where(F.col("place") <= max(1, k))


def trend(rows: DataFrame, group: list[str], step: str, loss: str) -> DataFrame:
    """Rows with the previous step and loss, and the best loss so far and its step (the earliest of equals)."""
    w = Window.partitionBy(*group).orderBy(step)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    best = F.min(F.struct(F.coalesce(F.col(loss), F.lit(float("inf"))).alias("l"), F.col(step).alias("s"))).over(upto)
    return rows.withColumns(
        {"prev_step": F.lag(step).over(w), "prev_loss": F.lag(loss).over(w), "__best": best}
    ).withColumns({"best_loss": F.col("__best.l"), "best_step": F.col("__best.s")}).drop("__best")


def eval_class(loss: Column, prev: Column, best: Column) -> Column:
    delta = loss - prev
    return (
        F.when(loss.isNull(), "unavailable").when(F.abs(loss - best) <= 1e-8, "best").when(prev.isNull(), "first")
        .when(delta <= -0.05, "improved").when(delta >= 0.15, "regressed").otherwise("moved")
    )


def ctc_preview_class(blank: Column, ratio: Column, collapsed: Column) -> Column:
    return (
        F.when(blank.isNull() | ratio.isNull(), "unavailable").when((blank >= 0.95) | (ratio <= 0.2), "collapsed")
        .when((blank >= 0.85) | (ratio <= 0.45) | (F.coalesce(collapsed, F.lit(0.0)) >= 0.5), "transitioning")
        .when((ratio >= 0.65) & (ratio <= 1.25) & (blank <= 0.82), "reasonable").otherwise("biased")
    )


def ar_preview_class(ratio: Column, collapsed: Column, eos: Column) -> Column:
    return (
        F.when(ratio.isNull(), "unavailable").when(
            (F.coalesce(collapsed, F.lit(0.0)) >= 0.5) | (ratio <= 0.35), "collapsing",
        )
        .when(eos < 0.5, "no EOS").when((ratio >= 0.65) & (ratio <= 1.35), "reasonable").otherwise("biased")
    )


def overall_class(loss: Column, prev: Column, best: Column, blank: Column) -> Column:
    calm = blank.isNull() | (blank <= 0.9)
    return (
        F.when(loss.isNull(), "comment-only").when((F.abs(loss - best) <= 1e-8) & calm, "reasonable-best")
        .when(
            prev.isNotNull() & (loss <= prev + 0.10) & calm, "reasonable",
        ).when(prev.isNotNull() & (loss > prev + 0.15), "needs-attention").otherwise("reasonable-with-noise")
    )


def sample_comment(ctc_error: Column, ar_error: Column, ctc_ratio: Column, ar_ratio: Column, eos: Column) -> Column:
    """A note on two decodings of one sample. The phrases are fixed values."""
    closer = (
        F.when(
            ctc_error.isNull() & ar_error.isNull(), "token error unavailable",
        ).when(ar_error.isNull(), "only CTC token error available").when(ctc_error.isNull(), "only AR token error available")
        .when(
            ctc_error + 1e-9 < ar_error, "CTC closer on token edit distance",
        ).when(ar_error + 1e-9 < ctc_error, "AR closer on token edit distance").otherwise("CTC and AR tie on token edit distance")
    )
    length = lambda name, r: F.when(r <= 0.5, f"{name} is short").when(r >= 1.5, f"{name} is long")
    return F.concat(
        F.concat_ws(
            "; ", closer, length("CTC", ctc_ratio), length("AR", ar_ratio), F.when(~eos, "AR did not emit EOS"),
        ),
        F.lit("."),
    )


def prune(saved: DataFrame, retained: DataFrame, path: str) -> DataFrame:
    """What is saved and not retained. Nothing is deleted: the list is the result."""
    return saved.join(retained.select(path), path, "left_anti")


def retained(records: DataFrame, kept: DataFrame, path: str, folder: str) -> DataFrame:
    """Records kept by path or by folder: two hash joins instead of one join with OR."""
    by_path = records.join(kept.where(F.col(path).isNotNull()).select(path), path, "left_semi")
    by_folder = records.join(kept.where(F.col(folder).isNotNull()).select(folder), folder, "left_semi")
    rest = by_folder.join(kept.where(F.col(path).isNotNull()).select(path), path, "left_anti")
    return by_path.select(*records.columns).unionByName(rest.select(*records.columns))


def pending(
    checkpoints: DataFrame, evaluated: DataFrame, path: str, modified: str, stable_seconds: float,
    now: Column | None = None, newest_only: bool = False, step: str = "step",
) -> DataFrame:
    """Checkpoints not evaluated yet whose file has been at rest; the newest of them, if asked."""
    age = (now if now is not None else F.current_timestamp()).cast("double") - F.col(modified).cast("double")
    open_ = checkpoints.join(evaluated.select(path), path, "left_anti").where(age >= max(0.0, stable_seconds))
    return open_.orderBy(F.col(step).desc(), F.col(path).desc()).limit(1) if newest_only else open_


def best_epoch(epochs: DataFrame, order: str, train: str, evaluation: str) -> DataFrame:
    """Epochs with their selection metric (evaluation loss unless NaN or missing, then training loss) and whether they are
    the best so far among epochs with the same kind of metric; earlier ones win ties."""
    missing = F.col(evaluation).isNull() | F.isnan(evaluation)
    named = epochs.withColumn("selection_metric_name", F.when(missing, "train_loss").otherwise("eval_loss")).withColumn(
        "selection_metric", F.when(missing, F.col(train)).otherwise(F.col(evaluation)),
    )
    before = Window.partitionBy("selection_metric_name").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.min("selection_metric").over(before)
    return named.withColumn("is_best", earlier.isNull() | (F.col("selection_metric") < earlier))


def resolve_max_steps(
    max_steps: int | None, epochs: int | None, steps_per_epoch: int | None, default: int = 100,
) -> int:
    if max_steps is not None and epochs is not None:
        raise ValueError("give max_steps or epochs, not both")
    if max_steps is not None:
        return max_steps
    if epochs is None:
        return default
    if steps_per_epoch is None:
        raise ValueError("epochs need a known number of samples")
    return max(1, steps_per_epoch) * epochs


def eval_limit(samples: int | None, epoch: int, epochs: int) -> int | None:
    """No cap if none is set, and none in the last epoch."""
    return None if samples is None or epoch >= epochs else samples


def eval_every(samples: int | None, own: int | None, save: int | None) -> int | None:
    return None if not samples or samples <= 0 else max(1, own or save or 1)


def eval_batch_size(own: int | None, train: int | None, default: int = 1) -> int:
    return max(1, own or train or default)


def merge_config(base: dict, override: dict) -> dict:
    """What is given on the command line replaces what the file says."""
    return {**base, **{k: v for k, v in override.items() if v is not None}}
