"""Text reports: a checkpoint's comment, joined examples of two decodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import format_number
from ..functions.maths import edit_distance
from ..functions.text import short_text
from .runs import sample_comment


def token_error(pred: Column, ref: Column) -> Column:
    """Edits over the reference's length, one at least; null where a list is missing."""
    return edit_distance(pred.cast("array<string>"), ref.cast("array<string>")) / F.greatest(F.lit(1), F.size(ref))


def token_ratio(pred: Column, ref: Column) -> Column:
    return F.when(pred.isNotNull() & ref.isNotNull(), F.size(pred) / F.greatest(F.lit(1), F.size(ref)))


def examples(ctc: DataFrame, ar: DataFrame, order: str, n: int) -> DataFrame:
    """The first n samples of ``ctc`` that ``ar`` has too, with both errors, both length ratios and a comment."""
    other = ar.select(
        "utt_id",
        F.struct(
            F.col("pred_token_ids").alias("p"), F.col("ref_text").alias("r"), F.col("pred_text").alias("t"),
            F.col("debug.eos_emitted").alias("eos"),
        ).alias("o"),
    )
    both = ctc.join(other, "utt_id").orderBy(order).limit(max(0, n))
    named = both.select(
        "utt_id", F.coalesce(
            F.nullif("ref_text", F.lit("")), F.col("o.r"), F.lit(""),
        ).alias("ref_text"), F.coalesce("pred_text", F.lit("")).alias("ctc_text"), F.coalesce("o.t", F.lit("")).alias("ar_text"),
        token_error(
            F.col("pred_token_ids"), F.col("ref_token_ids"),
        ).alias("ctc_error"), token_error(F.col("o.p"), F.col("ref_token_ids")).alias("ar_error"),
        token_ratio(
            F.col("pred_token_ids"), F.col("ref_token_ids"),
        ).alias("ctc_ratio"), token_ratio(F.col("o.p"), F.col("ref_token_ids")).alias("ar_ratio"), F.col("o.eos").alias("eos"),
    )
    return named.withColumn(
        "comment",
        sample_comment(F.col("ctc_error"), F.col("ar_error"), F.col("ctc_ratio"), F.col("ar_ratio"), F.col("eos")),
    ).drop("eos")


def example_text(limit: int = 160) -> Column:
    """One example of ``examples`` as lines for reading."""
    return F.concat_ws(
        "\n", F.concat(F.lit("### "), "utt_id"), F.concat(
            F.lit("- REF: "), short_text(F.col("ref_text"), limit),
        ), F.concat(F.lit("- CTC: "), short_text(F.col("ctc_text"), limit)),
        F.concat(F.lit("- AR: "), short_text(F.col("ar_text"), limit)), F.concat(
            F.lit("- Token error: "), format_number(F.col("ctc_error")), F.lit(" / "), format_number(F.col("ar_error")),
        ), F.concat(F.lit("- "), "comment"),
    )


def checkpoint_text(
    name: Column, status: Column, evaluation: Column, loss: Column, prev: Column, best: Column, best_step: Column,
) -> Column:
    """A checkpoint's comment as Markdown."""
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), name), F.lit(""), F.concat(
            F.lit("- Overall: `"), status, F.lit("`"),
        ), F.concat(F.lit("- Evaluation: "), evaluation), F.concat(F.lit("- Loss: "), format_number(loss)),
        F.concat(F.lit("- Previous loss: "), format_number(prev)), F.concat(
            F.lit("- Best loss so far: "), format_number(best), F.lit(" at step "), best_step,
        ),
    )
