"""Stable hash splits: a key's SHA-1 as a fraction of 2^64 says on which of two sides it falls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What rows are split by, the two sides, the side that is both, the metadata field of a sample's id.
BY_SAMPLE, BY_SHARD = "sample_id", "shard_name"
SIDES = ("train", "eval")
WHOLE = "all"
ID_FIELD = "sid"


def fraction(key: Column, seed: int) -> Column:
    """The first 64 bits of sha1("seed:key") over 2^64, exact up to the rounding of a double."""
    digest = F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


class HashSplit:
    """``share`` of the keys fall on the second of ``sides``. A key is a sample's id or its shard's name, so that samples of
    a shard stay together. Equal shares, seeds and keys give equal sides on any engine."""

    def __init__(
        self, share: float = 0.01, seed: int = 0, by: str = BY_SHARD, sides: tuple[str, str] = SIDES,
        id_field: str = ID_FIELD,
    ):
        wrong = {
            f"share {share} is not from 0 to below 1": not 0 <= share < 1,
            f"sides {sides} are not two different names": len(set(filter(None, sides))) != 2,
            f"rows are split by {BY_SAMPLE} or {BY_SHARD}, not by {by!r}": by not in (BY_SAMPLE, BY_SHARD),
            "the id field has no name": not id_field,
        }
        if complaints := [what for what, is_so in wrong.items() if is_so]:
            raise ValueError("; ".join(complaints))
        self.share, self.seed, self.by, self.sides, self.id_field = share, seed, by, sides, id_field

    def key(self, sample: Column | None, shard: Column | None) -> Column:
        chosen = {BY_SAMPLE: sample, BY_SHARD: shard}[self.by]
        if chosen is None:
            raise ValueError(f"without a {self.by} rows can't be split by it")
        return chosen

    def side(self, key: Column) -> Column:
        usual, drawn = map(F.lit, self.sides)
        return F.when(fraction(key, self.seed) < self.share, drawn).otherwise(usual) if self.share else usual

    def on(self, side: str, sample: Column | None = None, shard: Column | None = None) -> Column:
        """Whether a row is on a side; every row is on the whole."""
        if side not in (WHOLE, *self.sides):
            raise ValueError(f"there is no split {side!r} beside {WHOLE!r} and {self.sides}")
        return F.lit(True) if side == WHOLE else self.side(self.key(sample, shard)) == side


def truthy(value: Column) -> Column:
    """A JSON value (as text of get_json_object on its raw form) that Python would call true, else null."""
    return F.when(~value.isin("", "0", "0.0", "-0", "-0.0", "false", "null", "[]", "{}"), value)


def sample_id(value: Column, key: Column) -> Column:
    """The metadata's id, unless it is missing or falsy: then the member's key."""
    return F.coalesce(truthy(value), key)
