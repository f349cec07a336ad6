"""Text: normalisation, tokens, hotword lines, key=value pairs, short texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it.
SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"


def tokens(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, "\\p{P}", "")


def collapse(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def normalize_ascii(text: Column) -> Column:
    """The English normalisation on ASCII text, where compatibility forms and case folding add nothing to lower()."""
    return collapse(strip_punctuation(F.lower(text)))


def _english(s: str | None) -> str | None:
    if s is None:
        return None
    folded = unicodedata.normalize("NFKC", s).casefold()
    return " ".join("".join(c for c in folded if not unicodedata.category(c).startswith("P")).split())


def _chinese(s: str | None) -> str | None:
    if s is None:
        return None
    return "".join(
        c for c in "".join(unicodedata.normalize("NFKC", s).split()) if not unicodedata.category(c).startswith("P")
    )


def _mapped(f: Callable[[str | None], str | None]) -> Callable[[Column], Column]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f)

    return F.pandas_udf(run, "string")


def normalize_english() -> Callable[[Column], Column]:
    """NFKC, case folding, no punctuation, single spaces. Spark has no NFKC, so Arrow batches go to Python."""
    return _mapped(_english)


def normalize_chinese() -> Callable[[Column], Column]:
    """NFKC, no punctuation, no white space."""
    return _mapped(_chinese)


def short_text(text: Column, limit: int) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, max(0, limit - 1)), F.lit("…"))).otherwise(flat)


def hotword(line: Column, default_weight: float) -> Column:
    """struct(text, weight) of a line ``text`` or ``text<TAB>weight``; null for blank lines and comments."""
    s = F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")
    at = F.regexp_extract(s, "(?s)^(.*)\\t([^\\t]*)$", 1)
    name = F.regexp_replace(at, f"^{SPACE}+|{SPACE}+$", "")
    weight = F.regexp_extract(s, "(?s)^(.*)\\t([^\\t]*)$", 2).try_cast("double")
    plain = F.struct(s.alias("text"), F.lit(float(default_weight)).alias("weight"))
    parsed = F.when(weight.isNull(), plain).otherwise(F.struct(name.alias("text"), weight.alias("weight")))
    return F.when(
        (s == "") | s.startswith("#"), None,
    ).when(~s.contains("\t"), plain).when(name == "", None).otherwise(parsed)


def key_values(text: Column, signed: bool = True) -> Column:
    """map of ``key=number`` pairs, the last of equal keys."""
    pattern = "([a-zA-Z0-9_]+)=(-?[0-9.]+)" if signed else "([a-zA-Z0-9_]+)=([0-9.]+)"
    keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    last = F.filter(
        F.arrays_zip(
            keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.size(keys)).alias("i"),
        ), lambda x: F.size(F.filter(F.slice(keys, x["i"] + 1, F.size(keys)), lambda y: y == x["k"])) == 0
    )
    return F.when(
        F.size(keys) > 0, F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"].try_cast("double")))),
    ).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))


def language_code(name: Column) -> Column:
    return F.substring_index(F.regexp_replace(name, "^.*/", ""), ".", 1)


def step_number(path: Column) -> Column:
    """The last number of a file stem step-...-N, -1 if there is none."""
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), "\\.[^.]*$", "")
    return F.coalesce(
        F.nullif(F.regexp_extract(stem, "^step-(?:.*-)?([0-9]+)$", 1), F.lit("")).cast("long"), F.lit(-1).cast("long"),
    )
