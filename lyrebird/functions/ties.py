"""The order in which DuckDB's list sorts leave equal items.

They are not stable from 24 items on, but fixed: a list of under 128 items goes through a pattern-defeating quicksort that
partitions in blocks, followed here swap by swap and compared with DuckDB 2.0. Not followed are longer lists, the heap sort
after many uneven partitions, and sorted lists that make a large part of a batch; equal items stay in their order then."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

INSERTION, LONGEST, MOVES = 24, 127, 8


class _Uneven(Exception):
    pass


def grade_up(keys: list) -> list[int]:
    """Places of the items, those of the smallest first; equal ones as list_grade_up leaves them."""
    places = list(range(len(keys)))
    if INSERTION <= len(keys) <= LONGEST:
        try:
            _sort(places, keys, 0, len(keys), len(keys).bit_length() - 1, True)
            return places
        except _Uneven:
            pass
    return sorted(range(len(keys)), key=keys.__getitem__)


def _swap(a: list[int], i: int, j: int) -> None:
    a[i], a[j] = a[j], a[i]


def _sort(a: list[int], keys: list, begin: int, end: int, uneven: int, leftmost: bool) -> None:
    while (size := end - begin) >= INSERTION:
        half = begin + size // 2
        for i, j in ((half, begin), (begin, end - 1), (half, begin)):
            if keys[a[j]] < keys[a[i]]:
                _swap(a, i, j)
        if not leftmost and not keys[a[begin - 1]] < keys[a[begin]]:
            begin = _equal_left(a, keys, begin, end) + 1
            continue
        at, parted = _smaller_left(a, keys, begin, end)
        sides = ((begin, at), (at + 1, end))
        if min(j - i for i, j in sides) < size // 8:
            uneven -= 1
            if not uneven:
                raise _Uneven
            for i, j in sides:
                if j - i >= INSERTION:
                    _swap(a, i, i + (j - i) // 4)
                    _swap(a, j - 1, j - (j - i) // 4)
        elif parted and all(_insert(a, keys, i, j, MOVES) for i, j in sides):
            return
        _sort(a, keys, begin, at, uneven, leftmost)
        begin, leftmost = at + 1, False
    _insert(a, keys, begin, end)


def _insert(a: list[int], keys: list, begin: int, end: int, most: float = math.inf) -> bool:
    """Insertion sort; given up, and False, after so many moves."""
    moves = 0
    for i in range(begin + 1, end):
        item, j = a[i], i
        while j > begin and keys[item] < keys[a[j - 1]]:
            a[j] = a[j - 1]
            j -= 1
        a[j] = item
        moves += i - j
        if moves > most:
            return False
    return True


def _smaller_left(a: list[int], keys: list, begin: int, end: int) -> tuple[int, bool]:
    """Smaller items than the first to its left, others to its right; its new place, and if they were so before."""
    pivot = a[begin]
    smaller = lambda i: keys[a[i]] < keys[pivot]
    low, high = begin + 1, end - 1
    while smaller(low):
        low += 1
    while (low < high or low > begin + 1) and not smaller(high):
        high -= 1
    parted = low >= high
    if not parted:
        _swap(a, low, high)
        low += 1
        middle = low + (high - low) // 2
        lefts = [i for i in range(low, middle) if not smaller(i)]
        rights = [i for i in range(high - 1, middle - 1, -1) if smaller(i)]
        n = min(len(lefts), len(rights))
        if len(lefts) == len(rights):
            for i, j in zip(lefts, rights):
                _swap(a, i, j)
        elif n:
            ring = [x for pair in zip(lefts[:n], rights[:n]) for x in pair]
            items = [a[i] for i in ring]
            for i, item in zip(ring, items[1:] + items[:1]):
                a[i] = item
        low = middle
        for i in reversed(lefts[n:]):
            low -= 1
            _swap(a, i, low)
        for i in reversed(rights[n:]):
            _swap(a, i, low)
            low += 1
    a[begin], a[low - 1] = a[low - 1], pivot
    return low - 1, parted


def _equal_left(a: list[int], keys: list, begin: int, end: int) -> int:
    """Items equal to the first, which is the smallest, to its left; its new place."""
    pivot = a[begin]
    larger = lambda i: keys[pivot] < keys[a[i]]
    low, high = begin, end - 1
    while larger(high):
        high -= 1
    low += 1
    while (low < high or high + 1 < end) and not larger(low):
        low += 1
    while low < high:
        _swap(a, low, high)
        high -= 1
        while larger(high):
            high -= 1
        low += 1
        while not larger(low):
            low += 1
    a[begin], a[high] = a[high], pivot
    return high


def largest(scores: Column, k: int) -> Column:
    """Places of the k largest scores, of equal ones those that list_grade_up puts first when all are negated; NaN comes
    after numbers, null last."""

    def key(x: float | None) -> tuple[int, float]:
        return (2, 0.0) if x is None else (1, 0.0) if math.isnan(x) else (0, -x)

    @F.arrow_udf("array<int>")
    def run(lists: pa.Array) -> pa.Array:
        found = [None if x is None else grade_up([key(v) for v in x])[:k] for x in lists.to_pylist()]
        return pa.array(found, pa.list_(pa.int32()))

    return run(scores)
