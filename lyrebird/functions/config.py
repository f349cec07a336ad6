"""Driver-side configuration: where artefacts lie, whether an index fits a rule, vocabularies and prompts."""

from __future__ import annotations

import os

from .splits import BY_SAMPLE, ID_FIELD, HashSplit
from .tokenizers import Tokenizer, eos_of

#: An artefact's name in a folder of shards, and its suffix beside a single shard.
ARTEFACTS = {
    "index": ("webdataset_index.json", ".index.json"),
    "lengths": ("webdataset_lengths.jsonl", ".lengths.jsonl"),
    "summary": ("webdataset_lengths.summary.json", ".lengths.summary.json"),
    "buckets": ("webdataset_buckets/manifest.json", ".bucket_manifest.json"),
}
#: Bytes up to which a length index is said to fit into memory. Spark spills, so nothing depends on it here.
IN_MEMORY = 1 << 30


def artefact_path(kind: str, root: str, given: str | None = None) -> str:
    name, suffix = ARTEFACTS[kind]
    if given is not None:
        return given
    return os.path.join(root, name) if os.path.isdir(root) else os.path.splitext(root)[0] + suffix


def fits_in_memory(path: str, limit: int = IN_MEMORY) -> bool:
    return os.stat(path).st_size <= limit


def check_index(document: dict, rule: HashSplit) -> None:
    """An index is usable only for the rule it was made with. Older ones do not say how they were split: by sample."""
    # The fields of an index's split, and what a missing one means.
    fields = {
        "split_by": (rule.by, BY_SAMPLE), "eval_ratio": (rule.share, 0.0), "hash_seed": (rule.seed, 0),
        "utt_id_key": (rule.id_field, ID_FIELD),
    }
    for name, (asked, missing) in fields.items():
        if (made := document.get("split", {}).get(name, missing)) != asked:
            raise ValueError(f"the index was made with {name}={made!r}, asked for is {asked!r}")


def split_count(document: dict, split: str) -> int:
    return int(document["num_samples"] if split == "all" else document["splits"][split]["num_samples"])


def vocab_size(
    tokenizer: Tokenizer, configured: int | None = None, decoder: int | None = None, append_eos: bool = False,
    strict: bool = False,
) -> int:
    """The configured size, checked against the decoder's and, if ``strict``, the tokenizer's; else the decoder's or the tokenizer's."""
    if append_eos and eos_of(tokenizer) is None:
        raise ValueError("the tokenizer has no end mark to append")
    if decoder is not None and configured not in (None, decoder):
        raise ValueError(f"the vocabulary of {configured} is not the decoder's of {decoder}")
    if strict and configured is not None and configured != tokenizer.vocab_size:
        raise ValueError(f"the vocabulary of {configured} is not the tokenizer's of {tokenizer.vocab_size}")
    return configured or decoder or tokenizer.vocab_size


def prompt_ids(
    tokenizer: Tokenizer, before: str = "", after: str = "", suffix: str = "",
) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(tokenizer.encode(x)) if x else () for x in (before, after, suffix))


def text_extra(before: tuple[int, ...], after: tuple[int, ...], suffix: tuple[int, ...]) -> int:
    """Text tokens that a template adds to every sample: prompts, suffix and the end mark."""
    return len(before) + len(after) + len(suffix) + 1


def progress_total(document: dict | None, rule: HashSplit, split: str) -> int | None:
    """Samples of a split, for showing progress; none where there is no index, it was made otherwise or lacks the split."""
    try:
        check_index(document, rule)
        return split_count(document, split)
    except (AttributeError, KeyError, TypeError, ValueError):
        return None


def loader(
    root: str, buckets: str | None = None, lengths: str | None = None, limit: int = IN_MEMORY,
) -> tuple[str, str | None]:
    """What a folder of shards is read by, and the file it takes: a bucket manifest if there is one, else a length index
    that fits into memory, else the shards themselves. A file that was named must be there."""
    for kind, given in (("buckets", buckets), ("lengths", lengths)):
        path = artefact_path(kind, root, given)
        if os.path.exists(path):
            if kind == "buckets" or fits_in_memory(path, limit):
                return kind, path
        elif given is not None:
            raise FileNotFoundError(path)
    return "shards", None
