"""Byte-level BPE encoding and decoding in length-bucketed numpy matrices.

A text is cut into pieces by a pattern. The pieces that a worker has not met yet are laid out as rows of
byte tokens in padded matrices of like lengths. In each round every row merges its leftmost pair of least
rank: the ranks of all neighbouring pairs come from one hashed lookup, the row is compacted, and rows with
nothing left to merge leave the matrix. A piece of more than ``WIDEST`` bytes, whose rounds would take
time in the square of its length, is merged by a heap with the same order of merges, and so the same ids.

Ids are ranks. Decoding is a gather of each id's bytes out of one buffer. No special tokens are known.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated texts repeat their ids;
texts of any length are encoded whole, a bounded part of a batch at a time; empty tables give empty
results. Rows carry the id column and the results alone, so other columns' names do not matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Bytes of the widest piece that goes into a matrix.
WIDEST = 256
#: Cells of a matrix.
CELLS = 1 << 20
#: Pieces that a worker remembers; beyond, it forgets them all and starts anew.
REMEMBERED = 300_000
#: Characters of text that are cut into pieces at a time, unless one text has more.
AT_A_TIME = 1 << 19
NEVER = np.iinfo(np.int32).max


class PairTable:
    """Merged id of a pair of ids, by open addressing in numpy arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 3))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32)
        left, at = np.arange(len(pairs)), self._home(pairs)
        self.probes = 0
        while len(left):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = pairs[left[put]], merged[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs; NEVER where there is none or where a member is padding (below 0)."""
        keys = (a.astype(np.int64) << 32) | b
        out = np.full(len(keys), NEVER, np.int32)
        rest = np.flatnonzero((a >= 0) & (b >= 0))
        at = self._home(keys[rest])
        for _ in range(self.probes + 1):
            held = self.keys[at]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            rest, at = rest[on], (at[on] + 1) & (len(self.keys) - 1)
            if not len(rest):
                break
        return out


class _Index(dict):
    """Numbers for pieces in the order they are met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def gather(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of buffer[s : s + n]."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return buffer[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Codec:
    """raw: the lines of a rank file, each a token in base 64 and its rank."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {
            base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line.strip())
        }
        self.split = regex.compile(pattern).findall
        n = max(self.ranks.values()) + 1
        tokens = [b""] * n
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.bytes < 0).any():
            raise ValueError("the ranks lack a single byte")
        pairs, merged = [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b), merged.append(rank)
        self.pair = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))
        self.token_bytes = self._side(tokens)
        self.token_digits = self._side([b"%d," % i for i in range(n)])
        self._forget()

    @staticmethod
    def _side(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes

    def _forget(self) -> None:
        self.index = _Index()
        self.known = 0
        self.flat = np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Encode the pieces that were met since the last time."""
        if len(self.index) > self.known:
            pieces = [p.encode() for p in list(self.index)[self.known :]]
            flat, sizes = self.merge(pieces)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
            self.known = len(self.index)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        for i in np.flatnonzero(lengths > WIDEST):
            found[i] = self._merge_long(pieces[i])
        order = np.argsort(lengths, kind="stable")
        order = order[(lengths[order] > 0) & (lengths[order] <= WIDEST)]
        at = 0
        while at < len(order):
            least = int(lengths[order[at]])
            widest = least if least <= 16 else min(WIDEST, least + least // 4)
            stop = min(int(np.searchsorted(lengths[order], widest, "right")), at + max(1, CELLS // widest))
            rows = order[at:stop]
            for row, ids in zip(rows, self._merge_rows([pieces[i] for i in rows])):
                found[row] = ids
            at = stop
        sizes = np.array([len(x) for x in found], np.int64)
        return np.concatenate(found) if found else np.zeros(0, np.int32), sizes

    def _merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        joined = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.bytes[joined], -1).astype(np.int32)
        out: list[np.ndarray] = [None] * len(pieces)
        rows, left = np.arange(len(pieces)), sizes.copy()
        ranks = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while len(rows):
            if ids.shape[1] > 1:
                best = ranks.argmin(1)
                rank = ranks[np.arange(len(rows)), best]
            else:
                rank = np.full(len(rows), NEVER, np.int32)
            done = rank == NEVER
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k, : left[k]]
            if done.all():
                break
            if done.any():
                go = ~done
                rows, left, ids, ranks, best, rank = rows[go], left[go], ids[go], ranks[go], best[go], rank[go]
            # Compaction: the cell after the merged one goes, all behind it move up by one.
            each = np.arange(len(rows))
            ids[each, best] = rank
            cells = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cells + (cells > best[:, None]), 1)
            left = left - 1
            w = ids.shape[1]
            if w == 1:
                ranks = np.zeros((len(rows), 0), np.int32)
                continue
            cells = np.arange(w - 1)
            ranks = np.take_along_axis(ranks, cells + (cells >= best[:, None]), 1)
            for shift in (-1, 0):
                col = best + shift
                on = np.flatnonzero((col >= 0) & (col < w - 1))
                ranks[on, col[on]] = self.pair(ids[on, col[on]], ids[on, col[on] + 1])
            widest = int(left.max())
            if widest < w:
                ids, ranks = ids[:, :widest], ranks[:, : widest - 1]
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        n, get = len(piece), self.ranks.get
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        end = nxt[:]  # the part that starts at i is piece[i : end[i]], 0 if it was merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if end[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (r := get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := prv[i]) >= 0 and (r := get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = nxt[i]
        return np.array(out, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin and the last ends."""
        if len(self.index) > REMEMBERED:
            self._forget()
        met = [
            np.fromiter(
                map(self.index.__getitem__, self.split(t)), np.int64,
            ) if t else np.zeros(0, np.int64) for t in texts
        ]
        self._learn()
        pieces = np.concatenate(met) if met else np.zeros(0, np.int64)
        sizes = self.sizes[pieces]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[np.concatenate([[0], np.cumsum([len(x) for x in met], dtype=np.int64)])]
        return gather(self.flat, self.starts[pieces], sizes), bounds

    def _render(
        self, side: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, bounds: np.ndarray, cut: int,
    ) -> list[memoryview]:
        buffer, starts, sizes = side
        out = memoryview(gather(buffer, starts[ids], sizes[ids]))
        at = np.concatenate([[0], np.cumsum(sizes[ids])])[bounds].tolist()
        return [out[a : max(a, b - cut)] for a, b in zip(at, at[1:])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The bytes of each text's ids."""
        return self._render(self.token_bytes, ids, bounds, 0)

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """Each text's ids in decimal, joined by commas."""
        return self._render(self.token_digits, ids, bounds, 1)


@functools.lru_cache(maxsize=2)
def _codec(raw: bytes, pattern: str) -> Codec:
    return Codec(raw, pattern)


def parts(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about AT_A_TIME bytes of text in all columns each, one row at least."""
    sizes = sum(pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    group = np.cumsum(sizes) // AT_A_TIME
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _over(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str, fields: str, make) -> DataFrame:
    """(id, *fields) by make(codec, ids, bounds) -> arrays. The rank file (about 1 MB) is read on the driver and broadcast."""
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", *[x.split()[0] for x in fields.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern)
        for batch in batches:
            for a, b in parts(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, bounds = codec.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *make(codec, ids, bounds)], names=names)

    return kept.mapInArrow(
        run, f"id {kept.schema['id'].dataType.simpleString()}, {fields}",
    ).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded binary): the ids of each whole text, and the bytes they decode to."""

    def make(codec: Codec, ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        return [
            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
            pa.array([bytes(x) for x in codec.decode(ids, bounds)], pa.binary()),
        ]

    return _over(docs, id_col, text_col, path, pattern, "ids array<int>, decoded binary", make)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of what ``encode`` gives, without writing the ids out."""
    hexed = lambda views: pa.array([hashlib.sha256(v).hexdigest() for v in views], pa.string())

    def make(codec: Codec, ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.diff(bounds)), hexed(codec.decimals(ids, bounds)), hexed(codec.decode(ids, bounds))]

    return _over(docs, id_col, text_col, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
