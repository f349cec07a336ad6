"""Numbers: log sums, soft maxima, edit distances, nearest-rank quantiles, error rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = float("-inf")
#: Code points from 256 up to the surrogates.
MOST_ITEMS = 0xD800 - 256


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)), exact where either is minus infinity."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(a == NEVER, b).when(b == NEVER, a).otherwise(high + F.log1p(F.exp(low - high)))


def log_softmax(scores: Column) -> Column:
    """Array of log probabilities, shifted by the maximum first."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top.cast("double")))
    return F.transform(scores, lambda x: x.cast("double") - top.cast("double") - F.log(total))


def argmax(scores: Column) -> Column:
    """Place, from 0, of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def edit_distance(a: Column, b: Column) -> Column:
    """Edits between two arrays of strings. Each distinct item of the pair becomes a private code point, so that
    Spark's own levenshtein does the work. There are ``MOST_ITEMS`` of them below the surrogates; more distinct items are an error."""
    names = F.array_distinct(F.concat(a, b))
    names = F.when(
        F.size(names) > MOST_ITEMS,
        F.raise_error(F.lit("too many distinct items for an edit distance")).cast("array<string>"),
    ).otherwise(names)

    def spelt(x: Column) -> Column:
        return F.array_join(
            F.transform(
                x, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(names, t) + 255), 4, "0")), "UTF-16BE")
            ),
            "",
        )

    return F.levenshtein(spelt(a), spelt(b))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at place round_half_even((n - 1) q) of a sorted array; 0 for an empty one."""
    place = F.rint((F.size(values) - 1) * q).cast("int")
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(
        F.get(values, F.least(F.greatest(place, F.lit(0)), F.size(values) - 1)).cast("double")
    )


def rate(errors: Column, total: Column) -> Column:
    """Errors over tokens, 0 if there are none."""
    return F.when(total > 0, errors / total).otherwise(F.lit(0.0))


def sequence_score(log_p: Column, length: Column, length_bonus: float = 0.0, insertion_bonus: float = 0.0) -> Column:
    return log_p + (length_bonus + insertion_bonus) * length


def normalize(vector: Column, mean: Column, istd: Column) -> Column:
    return F.zip_with(F.zip_with(vector, mean, lambda x, m: x.cast("double") - m), istd, lambda x, s: x * s)
