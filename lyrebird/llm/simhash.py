"""SimHash near-duplicates found by a pigeonring filter.

Fingerprints. A text (null counts as empty) is lower-cased over A-Z, cut into words at ASCII white space and
into shingles of ``width`` words, repeats included; fewer words make one shingle of all of them, none make
the fingerprint zero. A bit is set if it is set in over half the XXH64 values (seed 42) of the shingles.
Fingerprints are counted by bit columns in numpy, a bounded number of shingles at a time, whatever the text.

Links. Two fingerprints link at ``distance`` or fewer differing bits. The 64 bits are cut into
``distance + 1`` segments on a ring. By the pigeonring principle some segment starts a chain whose first
k segments differ, for every k, in at most k * distance / (distance + 1) bits together: none in the first,
at most one in the first two, and so on. The join key is a start with its first two segments; one side
enumerates the one-bit changes of the second. The longer chains and the full distance are then conditions
of the join. Texts with equal fingerprints count once before anything is paired.

Groups. ``linked`` gives all links. For components fewer are enough: of the fingerprints under a join key the least is a
centre, and each fingerprint within half the distance of a centre hangs on it. Two that hang on one centre are linked,
so they need no row of their own; other links are summed up to one row for each two centres. So a large
group of near copies costs a row for each member, not for each pair.

Defined cases: rows of one fingerprint are one group, so repeated rows and ties share a component; a null
id is carried through and never chosen as component while another id is there; empty tables give empty
results. Only the id and text columns are read, so other columns, of whatever name, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import conf_int, settle, ship
from .components import components

#: Shingles whose bits are unpacked at a time (64 bytes each).
CHUNK = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def _hashes(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()
    n, h = len(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([h(b" ".join(words), 42)] if n else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    joined = b" ".join(words)
    starts = [0, *ends[: n - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n - width + 1)


def fingerprint_of(text: bytes | None, width: int = 4) -> int:
    """The fingerprint of one text as an unsigned integer."""
    return int(_many([text], width)[0])


_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _many(texts: list[bytes | None], width: int) -> np.ndarray:
    """Fingerprints of texts. Short ones are unpacked together; long ones a chunk at a time."""
    out, known = np.zeros(len(texts), np.uint64), {}
    rows: list[int] = []
    held: list[np.ndarray] = []

    def flush() -> None:
        if rows:
            sizes = np.array([len(x) for x in held])
            bits = np.unpackbits(
                np.concatenate(held).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little",
            )
            counts = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int32)
            out[rows] = ((2 * counts > sizes[:, None]) * _WEIGHTS).sum(1, dtype=np.uint64)
            rows.clear(), held.clear()

    load = 0
    copies = []
    for i, text in enumerate(texts):
        if not text:
            continue
        if text in known:
            copies.append((i, known[text]))
            continue
        known[text] = i
        hashes = _hashes(text, width)
        if len(hashes) > CHUNK:
            out[i] = ((2 * _bit_counts(hashes) > len(hashes)) * _WEIGHTS).sum(dtype=np.uint64)
        elif len(hashes):
            rows.append(i), held.append(hashes)
            load += len(hashes)
            if load >= CHUNK:
                flush()
                load = 0
    flush()
    for i, first in copies:
        out[i] = out[first]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, h, fp): fp is the fingerprint as a signed 64-bit integer, h is Spark's xxhash64 of the text."""
    ship(docs.sparkSession)
    kept = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.encode(F.col(text_col), "UTF-8").alias("raw"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = _many(part.column(2).to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fp)], names=["id", "h", "fp"],
                )

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, h long, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    parts = distance + 1
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def linked(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints of column ``fp`` at ``distance`` bits or fewer. With other
    columns beside ``fp``, rows must be distinct, and only pairs that differ in those columns are given, with them.

    For distances from 2 to 15, so that two segments fit into a key and a segment keeps 4 bits or more.
    """
    if not 2 <= distance <= 15:
        raise ValueError("distance must be from 2 to 15")
    ring = _segments(distance)
    parts = len(ring)
    budget = [k * distance // parts for k in range(1, parts + 1)]
    seg = lambda c, i: F.shiftrightunsigned(c, ring[i % parts][0]).bitwiseAND(
        F.lit((1 << ring[i % parts][1]) - 1)
    )
    differ = lambda x, y, i: F.bit_count(seg(x.bitwiseXOR(y), i))
    extra = [c for c in fps.columns if c != "fp"]

    def keys(i: int, change: int) -> F.Column:
        first, second = seg(F.col("fp"), i), seg(F.col("fp"), i + 1)
        wide = ring[(i + 1) % parts][1]
        return F.shiftleft(first, wide).bitwiseOR(second.bitwiseXOR(F.lit(change))) + F.lit(i << 48)

    if not extra:
        fps = _spread(fps.select("fp").distinct())
    own = fps.select("fp", *extra, F.explode(F.array(*[keys(i, 0) for i in range(parts)])).alias("key"))
    near = [
        keys(i, e) for i in range(parts) for e in (
            0, *(1 << j for j in range(ring[(i + 1) % parts][1] if budget[1] else 0))
        )
    ]
    probe = fps.select("fp", *extra, F.explode(F.array(*near)).alias("key"))
    x, y = F.col("p.fp"), F.col("q.fp")
    start = F.shiftrightunsigned(F.col("p.key"), 48)
    first = F.lit(None).cast("int")
    for i in reversed(range(parts)):
        sums, ok = F.lit(0), F.lit(True)
        for k in range(parts):
            sums = sums + differ(x, y, i + k)
            ok = ok & (sums <= budget[k])
        first = F.when(ok, i).otherwise(first)
    full = F.bit_count(x.bitwiseXOR(y)) <= distance
    # A pair can hold at several starts; only the first of them gives a row, so nothing is emitted twice.
    on = (F.col("p.key") == F.col("q.key")) & (x < y) & full & (first == start)
    for c in extra:
        on = on & (F.col(f"p.{c}") != F.col(f"q.{c}"))
    return probe.alias("p").join(own.alias("q"), on).select(
        x.alias("a"), y.alias("b"),
        *[F.col(f"{side}.{c}").alias(f"{c}_{n}") for c in extra for side, n in (("p", "a"), ("q", "b"))]
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Dealt to as many tasks as shuffles have: few bytes become many rows in what follows."""
    return rows.repartition(conf_int(rows.sparkSession, "spark.sql.shuffle.partitions", 200), "fp")


def _bundled(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b) that connect the same fingerprints as all links do, without the pairs of a group."""
    ring = _segments(distance)
    base = _spread(fps.select("fp").distinct())
    piece = lambda i: F.struct(
        F.lit(i).alias("i"),
        *[
            F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias(f"s{k}") for k, (s, w) in enumerate(
                (ring[i], ring[(i + 1) % len(ring)])
            )
        ]
    )
    keyed = base.select("fp", F.explode(F.array(*[piece(i) for i in range(len(ring))])).alias("key"))
    least = keyed.groupBy("key").agg(F.min("fp").alias("centre"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= distance // 2
    centred = settle(
        keyed.join(least, "key").groupBy("fp").agg(
            F.min(F.when(close, F.col("centre"))).alias("centre")
        ).select("fp", F.coalesce("centre", "fp").alias("centre"))
    )
    across = linked(_spread(centred), distance).groupBy("centre_a", "centre_b").agg(F.count("*").alias("n"))
    return centred.select(
        F.col("fp").alias("a"), F.col("centre").alias("b"),
    ).where("a <> b").union(across.select("centre_a", "centre_b"))


def _rooted(marked: DataFrame, distance: int) -> DataFrame:
    """(fp, root) for every fingerprint."""
    distinct = marked.select("fp").distinct()
    roots = settle(components(_bundled(distinct, distance)))
    return distinct.join(
        roots.withColumnRenamed("node", "fp"), "fp", "left",
    ).select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4,
) -> DataFrame:
    """(id_col, fp, component_id): component_id is the least id whose text is reachable over links."""
    marked = settle(fingerprints(docs, id_col, text_col, width))
    tied = marked.groupBy("fp").agg(F.min("id").alias("least")).join(_rooted(marked, distance), "fp")
    best = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = settle(tied.join(best, "root").select("fp", "component_id"))
    return marked.join(lookup, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Kept rows (three numbers each) up to which their keys are broadcast instead of joined by shuffle.
KEYS = 500_000


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4,
) -> DataFrame:
    """The rows of ``docs``, all columns, of which each stands for its group: that of the least id that is not null, then of the least hash of the text.

    Only ids, hashes and fingerprints are grouped. The texts are read once more, past the keys of the rows that
    stay, and are shuffled only where those keys are too many to broadcast. Of repeated rows one stays.
    """
    marked = settle(fingerprints(docs, id_col, text_col, width))
    counted = marked.groupBy("fp", "id", "h").agg(F.count("*").alias("n"))
    # One row for each fingerprint first: copies of a text are as many rows of one fingerprint.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("h"), F.col("n"))).alias("x")
    tied = counted.groupBy("fp").agg(first).join(_rooted(marked, distance), "fp")
    keys = settle(tied.groupBy("root").agg(F.min("x").alias("x")).select("x.id", "x.h", "x.n"))
    names = {c.lower() for c in docs.columns}
    i, h, n, own = (
        next(
            x for x in (f"__{c}{'_' * k}" for k in range(len(names) + 1)) if x not in names
        ) for c in ("i", "h", "n", "own")
    )
    keys = keys.toDF(i, h, n)
    side = F.broadcast(keys) if keys.count() <= KEYS else keys
    hit = docs.withColumn(own, F.xxhash64(text_col)).join(
        side, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)),
    )
    out = hit.where(F.col(n) == 1)
    if not keys.where(F.col(n) > 1).isEmpty():
        out = out.union(hit.where(F.col(n) > 1).dropDuplicates([i, h]))
    return out.drop(i, h, n, own)


def as_hex(fp: F.Column) -> F.Column:
    """16 lowercase hexadecimal digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
