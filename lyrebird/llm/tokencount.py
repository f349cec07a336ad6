"""Token counts of fields and sections, attributed by offsets.

A document is its fields joined by a separator, encoded once as a whole; so a token that a part's own
encoding would have cut differently is counted as it is in the document. Sections are the lines of a field
(each with its line end), or whole fields. Tokens have byte spans, which follow one another without gaps;
sections have byte spans in order. The two are joined by binary search for each slice of a batch.

A token that crosses a boundary goes by ``rule``: ``start`` to the section of its first byte, ``end`` to that
of its last, ``most`` to that with most of its bytes (the earlier of equals). What lies in a separator belongs
to the field before it. So the counts of a document's sections always add up to the document's count.

Defined cases: a null field counts as empty; an empty field is one empty section without tokens; repeated
rows give their sections each; documents of any length are encoded whole; empty tables give empty results.
Only the id and field columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, _codec, parts
from .common import ship

RULES = ("start", "end", "most")


def shares(ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. ends: where each token ends; cuts: where each section begins, and the last ends."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    inner = cuts[1:-1]
    if rule == "start":
        at = np.searchsorted(starts, inner, "left")
    elif rule == "end":
        at = np.searchsorted(ends, inner, "right")
    else:
        # A token is behind a cut if less than half of it, or none, lies before the cut.
        at = np.searchsorted(starts + ends, 2 * inner, "left")
        return _most(starts, ends, cuts) if (np.diff(cuts) < (ends - starts).max(initial=0)).any() else np.diff(
            np.concatenate([[0], _no_less_before(starts, ends, inner), [len(ends)]])
        )
    return np.diff(np.concatenate([[0], at, [len(ends)]]))


def _no_less_before(starts: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Tokens with half or more of their bytes before each cut (or all)."""
    middle = starts + ends
    return np.searchsorted(middle, 2 * inner, "right")


def _most(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sections may be shorter than a token: compare all the sections that a token meets."""
    first = np.searchsorted(cuts, starts, "right") - 1
    last = np.searchsorted(cuts, ends, "left") - 1
    first, last = np.clip(first, 0, len(cuts) - 2), np.clip(last, 0, len(cuts) - 2)
    best, most = first.copy(), np.minimum(ends, cuts[first + 1]) - starts
    for step in range(1, int((last - first).max(initial=0)) + 1):
        on = np.flatnonzero(first + step <= last)
        s = first[on] + step
        got = np.minimum(ends[on], cuts[s + 1]) - np.maximum(starts[on], cuts[s])
        more = got > most[on]
        best[on[more]], most[on[more]] = s[more], got[more]
    return np.bincount(best, minlength=len(cuts) - 1)


def attribute_slice(
    codec: Codec, rows: list[list[str]], separator: str, lines: bool, rule: str,
) -> tuple[np.ndarray, ...]:
    """(row, field, section, start, end, n_tokens) arrays; start and end are characters of the joined document."""
    texts = [separator.join(fields) for fields in rows]
    ids, bounds = codec.encode(texts)
    ends = np.cumsum(codec.token_bytes[2][ids])
    joined = np.frombuffer("".join(texts).encode(), np.uint8)
    characters = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
    at, row, field, section, cut = 0, [], [], [], []
    gap = len(separator.encode())
    width = len(rows[0]) if rows else 0
    for i, fields in enumerate(rows):
        for f, text in enumerate(fields):
            size = len(text) if text.isascii() else len(text.encode())
            if lines and size:
                marks = at + 1 + np.flatnonzero(joined[at : at + size - 1] == 10)
                begins = [at, *marks.tolist()]
            else:
                begins = [at]
            cut += begins
            row += [i] * len(begins)
            field += [f] * len(begins)
            section += range(len(begins))
            at += size + (gap if f + 1 < width else 0)
    cuts = np.array([*cut, at], np.int64)
    row = np.array(row, np.int64)
    # Documents end on token bounds, so one join serves the whole slice; empty sections get no tokens.
    full = np.diff(cuts) > 0
    counts = np.zeros(len(row), np.int64)
    if full.any():
        counts[full] = shares(ends, np.concatenate([cuts[:-1][full], [at]]), rule)
    offset = characters[cuts[np.searchsorted(row, row)]] if len(row) else row
    return row, np.array(field, np.int32), np.array(section, np.int32), characters[cuts[:-1]] - offset, characters[cuts[1:]] - offset, counts


def attribute(
    docs: DataFrame, fields: Sequence[str], path: str, pattern: str, id_col: str = "doc_id", separator: str = "\n\n",
    lines: bool = True, rule: str = "start",
) -> DataFrame:
    """(id_col, field, section, start, end, n_tokens): one row for each section of each row of docs."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    names = list(fields)
    kept = docs.select(
        F.col(id_col).alias("id"), *[F.coalesce(F.col(c), F.lit("")).alias(f"f{i}") for i, c in enumerate(names)]
    )
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern)
        labels = pa.array(names, pa.string())
        for batch in batches:
            for a, b in parts(*batch.columns[1:]):
                part = batch.slice(a, b - a)
                rows = list(zip(*[part.column(i + 1).to_pylist() for i in range(len(names))]))
                row, field, section, start, end, count = attribute_slice(codec, rows, separator, lines, rule)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)), labels.take(pa.array(field)), pa.array(section),
                        pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)),
                        pa.array(count.astype(np.int64)),
                    ],
                    names=["id", "field", "section", "start", "end", "n_tokens"],
                )

    return kept.mapInArrow(
        run, f"id {kind}, field string, section int, start long, end long, n_tokens long",
    ).withColumnRenamed("id", id_col)
