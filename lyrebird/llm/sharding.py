"""Weighted rendezvous hashing of record keys over shards, with gapless slots, in DataFrame functions only.

A row goes to the shard with the largest ``weight / -ln(u)``, u in (0, 1) being 52 bits of the MD5 of the
row's key and the shard's number. The key and the list of shards alone decide, so a shard more takes rows
only into itself, in proportion to its weight, and moves no row between the others.

Slots number the rows of a shard from 0 without gaps, in the order (bucket, key, size, CRC); the bucket is a hash of
key and CRC. Draws are made where the rows are read, once for each; rows are summed up to distinct (key, size, CRC) with
their count and written, then numbered within (shard, bucket) and moved by the number of rows in earlier buckets. So no
task holds a whole shard, a key with very many different rows (the null key, say) is dealt to all buckets of its
shard, and one with very many equal rows is one row until its slots are written out in blocks.

Defined cases: a null key hashes as the string ``null``; a null text has no bytes and CRC 0; repeated rows
go to one shard and get slots of their own; empty tables give empty results. Only the key and text columns
are read, so other columns, of whatever name, do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Buckets per shard; (shards x buckets) rows of counts are all that is broadcast.
BUCKETS = 256
#: Slots that one row of a repeated record writes out at a time.
BLOCK = 4096


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def draw(key: Column, salt: str | int) -> Column:
    """A number in (0, 1) that the key and the salt decide."""
    hexed = F.substring(F.md5(F.concat(_key(key), F.lit(f":{salt}"))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 52)


def winner(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, s) of the shard of the highest score, s being minus its number; of equal ones the lowest number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [
        F.struct(
            (F.lit(float(w)) / -F.log(draw(key, s))).alias("score"), F.lit(-s).alias("s"),
        ) for s, w in enumerate(weights, first)
    ]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, as an expression: no shuffle."""
    return (-winner(key, weights)["s"]).cast("int")


def bucket_of(key: Column, crc: Column) -> Column:
    return F.conv(
        F.substring(F.md5(F.concat(_key(key), F.lit(":slot:"), crc.cast("string"))), 1, 2), 16, 10,
    ).cast("int")


def place(
    rows: DataFrame, weights: Sequence[float], key_col: str = "doc_id", text_col: str = "text", overhead: int = 16,
) -> DataFrame:
    """(key_col, size, text_crc32, shard, slot, grown_shard): one row for each row of ``rows``."""
    key, n = F.col("key"), len(weights)
    measured = (
        rows.select(F.col(key_col).alias("key"), F.encode(F.col(text_col), "UTF-8").alias("raw"))
        .select(
            "key", (F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long") + overhead).alias("size"),
            F.coalesce(F.crc32("raw"), F.lit(0)).cast("long").alias("crc"),
        )
    )
    # One shard more competes with the winner alone, so its draw is the only one that is added.
    drawn = measured.select("*", winner(key, weights).alias("own"), winner(key, [sum(weights) / n], n).alias("more"))
    shard = (-F.col("own.s")).cast("int")
    placed = drawn.select(
        "key", "size", "crc", shard.alias("shard"),
        F.when(F.col("more.score") > F.col("own.score"), n).otherwise(shard).alias("grown_shard"),
        bucket_of(key, F.col("crc")).alias("bucket"),
    )
    each = settle(placed.groupBy(*placed.columns).agg(F.count("*").alias("n")))
    before = Window.partitionBy("shard", "bucket").orderBy(
        F.col("key").asc_nulls_first(), "size", "crc",
    ).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.groupBy("shard", "bucket").agg(F.sum("n").alias("held")).select(
        "shard", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"),
    )
    numbered = each.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("within"))
    # At most len(weights) * BUCKETS rows of three numbers: broadcast up to 40,000 shards, else joined by shuffle.
    side = F.broadcast(offsets) if len(weights) <= 40_000 else offsets
    blocks = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(BLOCK))).alias("first")
    return (
        numbered.join(side, ["shard", "bucket"])
        .select(
            "key", "size", "crc", "shard", "grown_shard", "n", (F.col("offset") + F.col("within")).alias("base"),
            blocks,
        )
        .select("*", F.explode(F.sequence("first", F.least(F.col("first") + BLOCK, F.col("n")) - 1)).alias("i"))
        .select(
            key.alias(key_col), "size", F.col("crc").alias("text_crc32"), "shard",
            (F.col("base") + F.col("i")).cast("long").alias("slot"), "grown_shard",
        )
    )


def sql(shards: int = 40, overhead: int = 16) -> str:
    """The same placement of table ``documents`` over equal shards in DuckDB's SQL. It has no CRC, so bytes are folded with a table."""
    crc_of = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        crc_of.append(n)
    folded = f"list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, ({crc_of}::BIGINT[])[(xor(a, b) & 255) + 1]))"
    return f"""WITH d AS (SELECT doc_id, text, row_number() OVER () AS rid, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(strlen(text), 0)::BIGINT + {overhead} AS size FROM documents),
    c AS (SELECT rid, xor({folded}, 4294967295) AS crc FROM d),
    u AS (SELECT rid, s, 1.0 / -ln((('0x' || substr(md5(k || ':' || s), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score FROM d, (SELECT unnest(range({shards + 1})) AS s)),
    p AS (SELECT rid, arg_max(s, score) FILTER (s < {shards}) AS shard, arg_max(s, score) AS grown FROM u GROUP BY rid)
    SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
        row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k || ':slot:' || crc), 1, 2))::INT, doc_id NULLS FIRST, size, crc) - 1 AS slot, grown::INT AS grown_shard
    FROM d JOIN c USING (rid) JOIN p USING (rid)"""
