"""Tokenizers behind one interface: a byte trie that needs no library, and optional ones by name."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Tokenizer(Protocol):
    vocab_size: int

    def encode(self, text: str) -> list[int]: ...
    def decode(self, ids: list[int]) -> str: ...


class ByteTrie:
    """Longest-listed-last byte tokens: at each byte, of the tokens that share its first two bytes the last listed that
    fits; else the single byte; a byte that is no token is an error. Decoding leaves out the end mark and gives nothing
    for unknown ids. Lines are ``id literal length``."""

    #: The least size of the vocabulary, and the end mark.
    LEAST, EOS = 65_536, 0

    def __init__(self, lines: list[str], eos: int | None = EOS, least: int = LEAST):
        self.tokens: dict[int, bytes] = {}
        for line in lines:
            if line.strip():
                number, literal, size = line[: line.index(" ")], line[
                    line.index(" ") : line.rindex(" ")
                ], line[line.rindex(" ") :]
                value = ast.literal_eval(literal.strip())
                value = value.encode() if isinstance(value, str) else value
                if len(value) != int(size):
                    raise ValueError(f"token {number} has not the length it says")
                self.tokens[int(number)] = value
        self.ids = {v: k for k, v in self.tokens.items()}
        self.by_two: dict[bytes, list[bytes]] = {}
        for value in self.tokens.values():
            if len(value) > 1:
                self.by_two.setdefault(value[:2], []).insert(0, value)
        self.vocab_size, self.eos = max(least, max(self.tokens, default=-1) + 1), eos

    def encode_bytes(self, raw: bytes) -> list[int]:
        out, at = [], 0
        while at < len(raw):
            token = next((t for t in self.by_two.get(raw[at : at + 2], ()) if raw.startswith(t, at)), raw[at : at + 1])
            out.append(self.ids[token])
            at += len(token)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_bytes(text.encode())

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens.get(i, b"") for i in ids if i != self.eos).decode("utf-8", "ignore")


def _pieces(path: str) -> Tokenizer:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    class Pieces:
        vocab_size, eos = model.vocab_size(), model.eos_id()
        encode = staticmethod(lambda text: list(model.encode(text)))
        decode = staticmethod(lambda ids: model.decode(list(ids)))

    return Pieces()


def _json(path: str) -> Tokenizer:
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)

    class Json:
        vocab_size = model.get_vocab_size()
        encode = staticmethod(lambda text: model.encode(text, add_special_tokens=False).ids)
        decode = staticmethod(lambda ids: model.decode(list(ids), skip_special_tokens=False))

    return Json()


def _ranks(path: str) -> Tokenizer:
    """Text tokens only: a special token in a text is an error, ids beyond the ranks decode to nothing."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    end = max(ranks.values()) + 1
    # Fixed value: the published pattern of this kind of ranks.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    model = tiktoken.Encoding("text", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": end})

    class Ranks:
        vocab_size, eos = end, end
        encode = staticmethod(lambda text: model.encode(text))
        decode = staticmethod(lambda ids: model.decode_bytes([i for i in ids if i < end]).decode("utf-8", "ignore"))

    return Ranks()


def _trie(path: str) -> Tokenizer:
    with open(path, encoding="utf-8") as f:
        return ByteTrie(f.read().splitlines())


#: The names that tokenizers go by.
REGISTRY: dict[str, Callable[[str], Tokenizer]] = {
    "sentencepiece": _pieces, "spm": _pieces, "hf": _json, "huggingface": _json, "qwen": _json, "whisper": _ranks,
    "tiktoken": _ranks, "byte_trie": _trie, "trie": _trie,
}


def build(kind: str, path: str | None) -> Tokenizer:
    if kind.lower() not in REGISTRY:
        raise ValueError(f"unknown tokenizer {kind!r}")
    if not path:
        raise ValueError(f"a {kind} tokenizer needs a model path")
    return REGISTRY[kind.lower()](path)


def eos_of(tokenizer: Tokenizer) -> int | None:
    eos = getattr(tokenizer, "eos", None)
    return eos if eos is not None and eos >= 0 else None


def encode(text: Column, make: Callable[[], Tokenizer]) -> Column:
    """ids of a text; ``make`` is called once for each task."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for s in batches:
            yield s.map(lambda t: None if t is None else tokenizer.encode(t))

    return run(text)


def decode(ids: Column, make: Callable[[], Tokenizer]) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for s in batches:
            yield s.map(lambda x: None if x is None else tokenizer.decode([int(i) for i in x]))

    return run(ids)
