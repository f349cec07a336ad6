"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised alike: lower case, every run of white space one space. An item is
cut into segments of ``segment`` characters, one every half segment and one at its end; an item that is
shorter is one segment. A segment of m characters is found in a document if some stretch of the document is
within ``m // per_edit`` edits of it. A document that holds any segment holds the item.

Filter. A stretch within k edits shares at least m - q + 1 - q * k of the segment's q-grams, and the matching
places lie on neighbouring diagonals (place in the document less place in the segment), within k to either
side. Places are counted in overlapping diagonal bands, each twice as wide as their step, so that the
diagonals of one stretch always lie within a single band. Bands that reach the bound are verified by an
alignment within the band, which gives the least number of edits.

The benchmark is read in blocks of bounded size (``BLOCK`` characters), each broadcast on its own: documents
are streamed once for each block and need no shuffle. Within a task, memory follows one slice of a batch.

Short items. Those of fewer than ``least`` characters cannot lose an edit and still share q-grams enough to tell them
from chance: they are looked for exactly, between word borders, down to ``EXACT`` characters.

Defined cases: null and empty texts hold nothing; null and empty items are not looked for, nor are items of fewer than
``EXACT`` characters, which any text may hold; repeated items are found each; repeated documents
give each their rows; whole texts are read, whatever their length, and what repeats itself within a text or an item is
counted a bounded number of matches at a time; ids may be of any type; empty tables give empty results. For
``clean`` all columns of the documents are kept as they are; ``found`` reads the two columns named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import parts
from .common import ship

Q, SEGMENT, PER_EDIT, LEAST = 10, 96, 12, 32
#: Items shorter than LEAST are looked for exactly, if they have so many characters.
EXACT = 12
#: Matching q-grams that are counted at a time.
MATCHES = 1 << 21
#: Characters of benchmark text that are broadcast at a time.
BLOCK = 4_000_000
#: Candidate bands that are aligned at a time.
ALIGNED = 4096
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on, by doubling the span."""
    span, power, value = 1, np.array(_MULTIPLIER), points.astype(np.uint64) + np.uint64(1)
    done, total, shift = None, 0, np.array(1, np.uint64)
    n = max(0, len(points) - q + 1)
    todo = q
    while todo:
        if todo & 1:
            part = value[total : total + n]
            done = part.copy() if done is None else done + shift * part
            shift = np.multiply(shift, power)
            total += span
        todo >>= 1
        if todo:
            value = value[: len(value) - span] + power * value[span:] if len(value) > span else value[:0]
            power = np.multiply(power, power)
            span *= 2
    done = done if done is not None else np.zeros(0, np.uint64)
    return done ^ (done >> np.uint64(31))


class Wanted:
    """The distinct segments of a block of the benchmark and an index of their q-grams; short items are kept as they are."""

    def __init__(
        self, items: list[tuple[object, str | None]], q: int = Q, segment: int = SEGMENT, per_edit: int = PER_EDIT,
        least: int = LEAST,
    ):
        if least < 2 * q or per_edit <= q or segment < least:
            raise ValueError("a segment of least characters must share a q-gram: least >= 2 * q and per_edit > q")
        self.q = q
        holders: dict[bytes, list[tuple[int, int]]] = {}
        shorts: dict[str, list[int]] = {}
        for number, (_, text) in enumerate(items):
            points = _points(whole := normal(text))
            if len(points) >= least:
                last = max(0, len(points) - segment)
                for place, at in enumerate(sorted({*range(0, last + 1, segment // 2), last})):
                    holders.setdefault(points[at : at + segment].tobytes(), []).append((number, place))
            elif len(points) >= EXACT:
                shorts.setdefault(whole, []).append(number)
        # Of equal segments, as repetitive text has many, one is searched for.
        self.items = list(holders.values())
        texts = [np.frombuffer(t, np.uint32) for t in holders]
        self.heads: dict[int, list[tuple[np.ndarray, list[int]]]] = {}
        for short, numbers in shorts.items():
            points = _points(short)
            self.heads.setdefault(int(_grams(points[:q], q)[0]), []).append((points, numbers))
        self.names = [name for name, _ in items]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.edits = self.sizes // per_edit
        self.bounds = self.sizes - q + 1 - q * self.edits
        self.step = int(2 * self.edits.max() + 1) if texts else 1
        self.text = np.zeros((len(texts), int(self.sizes.max()) if texts else 0), np.uint32)
        grams, owner, place = [], [], []
        for s, t in enumerate(texts):
            self.text[s, : len(t)] = t
            g = _grams(t, q)
            grams.append(g), owner.append(np.full(len(g), s)), place.append(np.arange(len(g)))
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner = np.concatenate(owner)[order] if grams else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, np.int64)
        self.grams, self.first, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        # A table of marks by the upper bits of the hash, 64 marks or more for each q-gram, at least 2 ** 20.
        self.bits = max(20, int(len(self.grams) * 64).bit_length())
        self.marks = np.zeros(1 << self.bits, bool)
        self.marks[(self.grams >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.starts = np.array(sorted(self.heads), np.uint64)
        self.marks[(self.starts >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, segment of the item, edits, place): every segment found in every text, at the end of its best stretch."""
        # Texts stand one after another with a gap that no q-gram or band can bridge.
        gap = np.zeros(int(self.sizes.max(initial=0)) + 4 * self.step, np.uint32)
        laid, begins, at = [gap], [], len(gap)
        for t in texts:
            p = _points(normal(t))
            begins.append(at)
            laid += [p, gap]
            at += len(p) + len(gap)
        text, begins = np.concatenate(laid), np.array(begins)
        hashed = _grams(text, self.q)
        spots = np.flatnonzero(self.marks[(hashed >> np.uint64(64 - self.bits)).astype(np.int64)])
        found = {(t, s): (edits, end) for t, s, edits, end in self._segments(text, begins, hashed, spots)}
        spread = [
            (t, number, place, edits, end) for (t, s), (edits, end) in found.items() for number, place in self.items[s]
        ]
        return spread + self._exact(text, begins, hashed, spots)

    def _exact(
        self, text: np.ndarray, begins: np.ndarray, hashed: np.ndarray, spots: np.ndarray,
    ) -> list[tuple[int, int, int, int, int]]:
        """Items that are too short for edits, between word borders; each is given once for a text, where it ends first."""
        out: dict[tuple[int, int], int] = {}
        inside = lambda i: i < len(text) and (chr(text[i]).isalnum() or chr(text[i]) == "_")
        for at in spots[np.isin(hashed[spots], self.starts)].tolist():
            for points, numbers in self.heads[int(hashed[at])]:
                end = at + len(points)
                if not inside(at - 1) and not inside(end) and np.array_equal(text[at:end], points):
                    t = int(np.searchsorted(begins, at, "right")) - 1
                    for number in numbers:
                        out.setdefault((t, number), end - 1 - int(begins[t]))
        return [(t, number, 0, 0, end) for (t, number), end in out.items()]

    def _segments(
        self, text: np.ndarray, begins: np.ndarray, hashed: np.ndarray, spots: np.ndarray,
    ) -> list[tuple[int, int, int, int]]:
        """(text, segment, edits, place) of the distinct segments."""
        if not len(self.sizes) or not len(spots):
            return []
        slot = np.minimum(np.searchsorted(self.grams, hashed[spots]), len(self.grams) - 1)
        real = self.grams[slot] == hashed[spots]
        spots, slot = spots[real], slot[real]
        bands = len(text) // self.step + 2
        # Steps are counted first, a bounded number of matches at a time; the band from b on holds the steps b and b + 1.
        keys, counts = [], []
        load = np.cumsum(self.counts[slot])
        for at in np.split(np.arange(len(slot)), np.flatnonzero(np.diff(load // MATCHES)) + 1):
            sizes = self.counts[slot[at]]
            ends = np.cumsum(sizes)
            entry = np.repeat(
                self.first[slot[at]] - (ends - sizes), sizes,
            ) + np.arange(int(ends[-1]) if len(ends) else 0)
            band = (np.repeat(spots[at], sizes) - self.place[entry]) // self.step
            some, n = np.unique(self.owner[entry] * bands + band, return_counts=True)
            keys.append(some), counts.append(n)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        after = np.searchsorted(key, key + 1)
        follows = np.where(
            (after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + 1),
            count[np.minimum(after, len(key) - 1)], 0,
        )
        before = np.searchsorted(key, key - 1)
        alone = ~((before < len(key)) & (key[np.minimum(before, len(key) - 1)] == key - 1))
        bound = self.bounds[key // bands]
        keep = key[count + follows >= bound]
        # A step whose predecessor is empty also ends a band, with the same count as the step alone.
        keep = np.union1d(keep, key[alone & (count >= bound)])
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for i in range(0, len(keep), ALIGNED):
            part = keep[i : i + ALIGNED]
            s = part // bands
            edits, place = self._align(text, s, (part % bands) * self.step)
            for k in np.flatnonzero(edits <= self.edits[s]):
                t = int(np.searchsorted(begins, place[k], "right")) - 1
                if edits[k] < best.get((t, int(s[k])), (0, 0, 1 << 30, 0))[2]:
                    best[t, int(s[k])] = (t, int(s[k]), int(edits[k]), int(place[k] - begins[t]))
        return list(best.values())

    def _align(self, text: np.ndarray, s: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each segment against any stretch within two steps from the diagonal on, and where it ends."""
        slack = int(self.edits.max())
        width = 2 * self.step + 2 * slack
        low = diagonal - slack
        columns = np.arange(width, dtype=np.int32)
        big = np.int32(1 << 20)
        row = np.zeros((len(s), width), np.int32)  # the stretch may start at any diagonal of the band
        final = np.zeros((len(s), width), np.int32)
        for i in range(self.text.shape[1]):
            at = np.clip(low[:, None] + i + columns, 0, len(text) - 1)
            same = text[at] == self.text[s, i][:, None]
            step = row + ~same
            step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
            row = np.minimum.accumulate(step - columns, axis=1) + columns
            ended = self.sizes[s] == i + 1
            if ended.any():
                final[ended] = row[ended]
        best = final.argmin(1)
        return np.minimum(final[np.arange(len(s)), best], big), low + self.sizes[s] - 1 + best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    held, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK:
            yield held
            held, size = [], 0
    yield held


def found(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", **settings: int
) -> DataFrame:
    """(id_col, item_col, segments, edits, ends): for each document and item, how many segments were found, the least edits, and where the found stretches end in the normalised text."""
    spark = docs.sparkSession
    ship(spark)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = (kept.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString())
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted = Wanted(shared.value, **settings)
            for batch in batches:
                for a, b in parts(batch.column(1)):
                    part = batch.slice(a, b - a)
                    rows: dict[tuple[int, int], list[tuple[int, int]]] = {}
                    for t, item, _, edits, place in wanted.search(part.column(1).to_pylist()):
                        rows.setdefault((t, item), []).append((edits, place))
                    ids, names = part.column(0), wanted.names
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([t for t, _ in rows], pa.int64())),
                            pa.array([names[i] for _, i in rows], item_kind),
                            pa.array([len(x) for x in rows.values()], pa.int64()),
                            pa.array([min(e for e, _ in x) for x in rows.values()], pa.int32()),
                            pa.array([sorted(p for _, p in x) for x in rows.values()], pa.list_(pa.int64())),
                        ],
                        names=["id", "item", "segments", "edits", "ends"],
                    )

        part = kept.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, segments long, edits int, ends array<long>")
        out = part if out is None else out.union(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", **settings: int
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    at, out = docs.columns.index(text_col), docs
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted = Wanted(shared.value, **settings)
            for batch in batches:
                for a, b in parts(batch.column(at)):
                    part = batch.slice(a, b - a)
                    held = {t for t, *_ in wanted.search(part.column(at).to_pylist())}
                    yield part.filter(pa.array([i not in held for i in range(b - a)]))

        out = out.mapInArrow(run, docs.schema)
    return out
