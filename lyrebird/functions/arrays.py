"""Arrays: end marks, label masks, padding, subsequences, hotword bonuses, top tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def append_eos(ids: Column, eos: int) -> Column:
    """ids with the end mark, once."""
    return F.when(
        (F.size(ids) > 0) & (F.try_element_at(ids, F.lit(-1)) == eos), ids,
    ).otherwise(F.concat(ids, F.array(F.lit(eos).cast("int"))))


def strip_eos(ids: Column, eos: int) -> Column:
    return F.when(
        (F.size(ids) > 0) & (F.try_element_at(ids, F.lit(-1)) == eos), F.slice(ids, 1, F.size(ids) - 1),
    ).otherwise(ids)


def decoder_target(ids: Column, suffix: list[int], eos: int) -> Column:
    """One trailing end mark off, the suffix and the end mark on."""
    return F.concat(strip_eos(ids, eos), F.array(*[F.lit(x).cast("int") for x in [*suffix, eos]]))


def label_mask(target: Column, prompt: int, audio: Column) -> Column:
    """What a decoder is to predict: nothing on prompt and audio (and the start), then the target."""
    return F.concat(F.array_repeat(F.lit(IGNORED), (audio + prompt).cast("int")), target)


def pad(ids: Column, size: Column, value: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value).cast("int"), F.greatest(F.lit(0), size - F.size(ids)).cast("int")))


def count_matches(items: Column, pattern: Column) -> Column:
    """Overlapping occurrences of a pattern."""
    places = F.when(
        (F.size(pattern) > 0) & (F.size(items) >= F.size(pattern)),
        F.sequence(F.lit(1), F.size(items) - F.size(pattern) + 1),
    ).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.slice(items, i, F.size(pattern)) == pattern))


def suffix_prefix(items: Column, pattern: Column) -> Column:
    """Length of the longest end of items that begins the pattern, shorter than the pattern."""
    most = F.least(F.size(items), F.size(pattern) - 1)
    sizes = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda k: F.slice(items, -k, k) == F.slice(pattern, 1, k))
    return F.coalesce(F.array_max(fits), F.lit(0))


def hotword_bonus(items: Column, hotwords: list[tuple[list, float]], scale: float) -> Column:
    """Weights of all full matches, and of the best partial match at the end, scaled by its share of the hotword."""
    full, partial = F.lit(0.0), F.lit(0.0)
    for words, weight in hotwords:
        pattern = F.array(*[F.lit(w) for w in words])
        full = full + weight * count_matches(items, pattern)
        if scale > 0:
            partial = F.greatest(partial, weight * scale * suffix_prefix(items, pattern) / float(len(words)))
    return full + partial


def top_tokens(scores: Column, k: int, blank: int | None = None) -> Column:
    """Places of the k largest scores, largest first, NaN and null last, and earlier ones first among equals; blank
    always among them."""
    ranked = F.sort_array(
        F.transform(scores, lambda x, i: F.struct(x.isNull().alias("n"), (-x).alias("s"), i.alias("i")))
    )
    best = F.transform(F.slice(ranked, 1, k), lambda x: x["i"])
    return best if blank is None else F.array_union(best, F.array(F.lit(blank)))


def collapse_runs(ids: Column, blank: Column) -> Column:
    """Greedy decoding: drop blanks and what repeats the item just before it."""
    kept = F.filter(
        F.transform(
            ids, lambda x, i: F.struct(x.alias("x"), (x.eqNullSafe(F.get(ids, i - 1)) & (i > 0)).alias("again"))
        ), lambda s: (s["x"] != blank) & ~s["again"]
    )
    return F.transform(kept, lambda s: s["x"])
