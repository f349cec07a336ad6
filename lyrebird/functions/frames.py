"""Lengths in frames: inference from metadata, buckets, subsampling, spans in milliseconds, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DURATION_BOUNDS = (5.0, 10.0, 15.0, 20.0)


def infer_frames(
    num_frames: Column, begin: Column, end: Column, duration: Column, num_samples: Column, sample_rate: Column,
    unknown: Column | None = None,
) -> Column:
    """Frames of 10 ms: a positive num_frames, else of the first time given: begin and end, duration, samples over
    rate. Halves round to even, one frame at least. A time given that is not positive, or none, is an error, or
    has the frames in ``unknown``."""
    seconds = (
        F.when(begin.isNotNull() & end.isNotNull(), end.cast("double") - begin.cast("double"))
        .when(duration.isNotNull(), duration.cast("double"))
        .when(
            num_samples.isNotNull() & sample_rate.isNotNull(), num_samples.cast("double") / sample_rate.cast("double"),
        )
    )
    whole = F.when(num_frames.isNotNull(), num_frames.cast("long"))
    if unknown is None:
        unknown = F.raise_error(F.lit("no length can be inferred from the metadata"))
    return F.when(whole > 0, whole).when(seconds > 0, frames_of(seconds)).otherwise(unknown.cast("long"))


def frames_of(seconds: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.rint(seconds * 100).cast("long"))


def bucket_id(frames: Column, width: int = 80) -> Column:
    return F.floor(frames / width).cast("long")


def duration_bucket(seconds: Column, bounds: tuple[float, ...] = DURATION_BOUNDS) -> Column:
    """Half-open buckets named by their bounds."""
    low, out = 0, None
    for b in bounds:
        label = f"{low:g}-{b:g}s"
        out = F.when(seconds < b, label) if out is None else out.when(seconds < b, label)
        low = b
    return out.otherwise(f"{low:g}+s")


def subsampled_length(n: Column) -> Column:
    """Output length of two convolutions of strides 2 and 3."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.floor((n - 1) / 2) - 2) / 3).cast("long"))


def frame_span(start: Column, end: Column, frontend: str = "conv2d6") -> tuple[Column, Column]:
    """First and last input frame of a span of encoder steps."""
    if frontend == "conv2d6":
        return start * 6, end * 6 + 10
    if frontend == "linear":
        return start, end
    raise ValueError(f"unknown frontend {frontend!r}")


def span_ms(start_frame: Column, end_frame: Column, shift: float = 10.0) -> tuple[Column, Column]:
    return start_frame * shift, (end_frame + 1) * shift


def local_batch_size(bucket: Column, width: int, most: int, budget: int | None) -> Column:
    """Samples per device so that a batch of the bucket's longest samples stays within the frame budget."""
    if most <= 0:
        raise ValueError("the largest batch must be positive")
    if not budget or budget <= 0:
        return F.lit(most).cast("long")
    upper = F.greatest(F.lit(1).cast("long"), (bucket.cast("long") + 1) * width)
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), F.floor(F.lit(budget) / upper)))


def max_new_tokens(frames: Column, factor: float, explicit: int | None = None) -> Column:
    if explicit is not None:
        return F.lit(max(1, explicit)).cast("long")
    return F.greatest(F.lit(16).cast("long"), F.least(F.lit(1024).cast("long"), F.ceil(frames * factor)))


def memory_token_budget(tokens: Column, peak_bytes: Column, target_gib: float) -> Column:
    """Tokens that would fill the target memory at the observed bytes per token; 0 on bad input."""
    if target_gib <= 0:
        return F.lit(0).cast("long")
    target = int(target_gib * 1024**3)
    scaled = F.floor(
        tokens.cast("decimal(20,0)") * F.lit(target).cast("decimal(18,0)") / peak_bytes.cast("decimal(20,0)")
    ).cast("long")
    return F.when(
        (tokens > 0) & (peak_bytes > 0), F.greatest(F.lit(1).cast("long"), scaled),
    ).otherwise(F.lit(0).cast("long"))


def tenths(x: Column) -> Column:
    """x with one decimal as Python prints it: rounded by its binary value, halves to even. Spark rounds the shortest
    decimal that stands for a double: 9.35 to 9.4, though the double lies below."""
    whole = F.floor(F.abs(x))
    # What is lost beyond 59 binary places belongs to numbers under 1/128.
    part = ((F.abs(x) - whole) * float(1 << 59)).cast("long") * 10
    digit, rest = F.shiftright(part, 59), part.bitwiseAND((1 << 59) - 1)
    up = (rest > 1 << 58) | ((rest == 1 << 58) & (digit % 2 == 1))
    return F.when(
        x.isNotNull(), F.format_string("%.1f", F.signum(x) * (whole * 10 + digit + up.cast("long")) / 10.0),
    )


def format_bytes(n: Column, largest: str = "TiB") -> Column:
    """1536 -> 1.5KiB."""
    fixed = lambda k, unit: F.concat(tenths(n / float(1024**k)), F.lit(unit))
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    out = fixed(0, "B")
    for k, unit in enumerate(units[1 : units.index(largest) + 1], 1):
        out = F.when(n >= 1024**k, fixed(k, unit)).otherwise(out)
    return out


def format_seconds(left: Column) -> Column:
    """42s, 3.5m, 1.2h; what is under a minute, times past among it, in whole seconds."""
    return (
        F.when(left < 60, F.format_string("%.0fs", F.rint(left)))
        .when(left < 3600, F.concat(tenths(left / 60), F.lit("m")))
        .when(left == float("inf"), "infh")
        .otherwise(F.concat(tenths(left / 3600), F.lit("h")))
    )


def format_eta(elapsed: Column, completed: Column, total: Column) -> Column:
    """Time left at the rate so far; n/a where nothing or everything is done."""
    per_second = completed / F.greatest(elapsed, F.lit(1e-6))
    left = (total - completed) / F.greatest(per_second, F.lit(1e-6))
    return F.when(
        total.isNull() | (completed <= 0) | (completed >= total), "n/a",
    ).otherwise(format_seconds(left))


def format_number(x: Column, digits: int = 4) -> Column:
    return F.coalesce(
        F.format_string(f"%.{digits}f", F.bround(x, digits)), F.lit("n/a"),
    ) if digits else F.coalesce(F.rint(x).cast("long").cast("string"), F.lit("n/a"))


def ramp(step: Column, start: int, end: int, low: float, high: float) -> Column:
    """A probability that rises linearly between two steps."""
    if end <= start:
        return F.when(step >= end, high).otherwise(low)
    return low + (high - low) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - start) / float(end - start)))


def throughput(step: Column, elapsed: Column, start: int = 0) -> Column:
    """Steps a second since ``start``; one step at least, and no division by nothing."""
    return F.greatest(step - start, F.lit(1)) / F.greatest(elapsed, F.lit(1e-6))
