"""Decoding of frame scores: greedy, prefix beam search, forced alignment, rescoring.

Greedy decoding is column functions. Beam search and alignment are sequential over frames, so they are Arrow
batches in Python, one utterance at a time; utterances are independent and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import collapse_runs
from ..functions.frames import frame_span, span_ms
from ..functions.maths import argmax, log_softmax

NEVER = float("-inf")
HYPOTHESES = "array<struct<token_ids:array<int>,score:double,blank_score:double,non_blank_score:double>>"


def greedy(scores: Column, blank: int) -> Column:
    """scores: an array of frames, each an array of token scores."""
    return collapse_runs(F.transform(scores, argmax), F.lit(blank))


def greedy_runs(frames: DataFrame, group: list[str], order: list[Column], token: str) -> DataFrame:
    """(group, run, token, start, end): spans of equal neighbouring tokens, by places from 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = frames.select(
        *group, F.col(token).alias("token"), (F.row_number().over(w) - 1).alias("__at"),
        F.lag(token).over(w).alias("__last"),
    )
    starts = marked.withColumn(
        "__new", (~F.col("token").eqNullSafe(F.col("__last")) | (F.col("__at") == 0)).cast("int"),
    )
    run = F.sum("__new").over(Window.partitionBy(*group).orderBy("__at")) - 1
    return starts.withColumn("run", run).groupBy(*group, "run").agg(
        F.first("token").alias("token"), F.min("__at").alias("start"), F.max("__at").alias("end"),
    )


class Prefixes:
    """Token sequences as nodes of a tree: equal ones have one number, and a longer one costs one entry."""

    def __init__(self):
        self.parent, self.token, self.numbers = [-1], [-1], {}

    def longer(self, node: int, token: int) -> int:
        number = self.numbers.setdefault((node, token), len(self.parent))
        if number == len(self.parent):
            self.parent.append(node), self.token.append(token)
        return number

    def tokens(self, node: int) -> tuple[int, ...]:
        out = []
        while node:
            out.append(self.token[node])
            node = self.parent[node]
        return tuple(reversed(out))


class Bonus:
    """Length, insertion and hotword bonuses of a prefix."""

    def __init__(
        self, length: float = 0.0, insertion: float = 0.0, hotwords: list[tuple[tuple[int, ...], float]] = (),
        scale: float = 0.0,
    ):
        self.per, self.hotwords, self.scale, self.known = length + insertion, list(hotwords), scale, {}

    def __call__(self, prefix: tuple[int, ...]) -> float:
        if not prefix:
            return 0.0
        if prefix not in self.known:
            full, part = 0.0, 0.0
            for words, weight in self.hotwords:
                k = len(words)
                full += weight * sum(prefix[i : i + k] == words for i in range(len(prefix) - k + 1))
                if self.scale > 0:
                    part = max(
                        [
                            part,
                            *(
                                weight * self.scale * j / k for j in range(
                                    1, min(len(prefix), k - 1) + 1,
                                ) if prefix[-j:] == words[:j]
                            )
                        ]
                    )
            self.known[prefix] = full + part
        return self.per * len(prefix) + self.known[prefix]


def prefix_beam(
    log_p: np.ndarray, blank: int, beam: int, top: int | None = None, bonus: Bonus | None = None,
) -> list[tuple[tuple[int, ...], float, float, float]]:
    """(tokens, score, blank score, other score), best first; the score holds the bonuses. Of equal scores the prefix comes
    first that is reached first, going through prefixes in the order of the beam and for each through the frame's tokens.

    The beam is arrays: a node of the tree for each prefix and the log probabilities of its paths that end on blank and
    on a token. A frame makes one matrix of all longer prefixes; one that is in the beam itself is added to it there.
    """
    tree, nodes, ends, ranks = Prefixes(), [0], np.array([[0.0, NEVER]]), np.zeros(1)
    for frame in log_p:
        frame = np.asarray(frame, float)
        tokens = np.arange(len(frame))
        if top is not None and 0 < top < len(frame):
            tokens = np.argsort(-frame, kind="stable")[:top]
            tokens = tokens if blank in tokens else np.append(tokens, blank)
        at = {t: k for k, t in enumerate(tokens.tolist())}
        last = np.array([tree.token[n] for n in nodes])
        whole = np.logaddexp(ends[:, 0], ends[:, 1])
        again = np.array([t in at for t in last.tolist()])
        held = np.stack([whole + frame[blank], np.where(again, ends[:, 1] + frame[last], NEVER)], 1)
        grown = np.where(tokens == last[:, None], ends[:, :1], whole[:, None]) + frame[tokens]
        # When each is reached; a prefix is held before it grows by its last token again.
        reached = np.arange(len(nodes))[:, None] * len(tokens) + np.arange(len(tokens)) + 0.5 * (tokens == last[:, None])
        kept = np.array(
            [i * len(tokens) + min(at[blank], at.get(t, len(tokens))) for i, t in enumerate(last.tolist())], float,
        )
        free = np.ones(grown.shape, bool)
        free[:, at[blank]] = False
        row = {n: i for i, n in enumerate(nodes)}
        for j, n in enumerate(nodes):
            i = row.get(tree.parent[n])
            if i is not None and again[j]:
                k = at[last[j]]
                held[j, 1] = np.logaddexp(held[j, 1], grown[i, k])
                kept[j], free[i, k] = min(kept[j], reached[i, k]), False
        from_, by = np.nonzero(free)
        ends = np.concatenate([held, np.stack([np.full(len(from_), NEVER), grown[from_, by]], 1)])
        ranks = np.logaddexp(ends[:, 0], ends[:, 1])
        if bonus:
            prefixes = [tree.tokens(n) for n in nodes]
            ranks = ranks + np.array(
                [bonus(p) for p in prefixes] + [bonus((*prefixes[i], int(tokens[k]))) for i, k in zip(from_, by)]
            )
        best = np.lexsort((np.concatenate([kept, reached[from_, by]]), -ranks))[: max(1, beam)]
        new = lambda c: nodes[c] if c < len(nodes) else tree.longer(
            nodes[from_[c - len(nodes)]], int(tokens[by[c - len(nodes)]]),
        )
        nodes, ends, ranks = [new(c) for c in best.tolist()], ends[best], ranks[best]
    return [(tree.tokens(n), float(r), float(b), float(t)) for n, r, (b, t) in zip(nodes, ranks, ends)]


def align(log_p: np.ndarray, ids: list[int], blank: int) -> list[tuple[int, int]]:
    """First and last frame of each token on the best path through blank, token, blank, ...; ties prefer to stay, and to end on blank."""
    if not ids:
        return []
    if not len(log_p):
        raise ValueError("there are no frames to align")
    states = np.full(2 * len(ids) + 1, blank)
    states[1::2] = ids
    n = len(states)
    skip = np.zeros(n, bool)
    skip[2:] = (states[2:] != blank) & (states[2:] != states[:-2])
    score = np.full(n, NEVER)
    score[:2] = log_p[0, states[:2]]
    back = np.zeros((len(log_p), n), np.int8)
    for t in range(1, len(log_p)):
        one, two = np.full(n, NEVER), np.full(n, NEVER)
        one[1:], two[2:] = score[:-1], score[:-2]
        two[~skip] = NEVER
        ways = np.stack([score, one, two])
        back[t] = ways.argmax(0)
        score = ways.max(0) + log_p[t, states]
    end = n - 1 if score[n - 1] >= score[n - 2] else n - 2
    if score[end] == NEVER:
        raise ValueError("no path holds all tokens")
    path = np.zeros(len(log_p), np.int64)
    for t in range(len(log_p) - 1, -1, -1):
        path[t] = end
        end -= back[t, end]
    spans = []
    for k in range(len(ids)):
        at = np.flatnonzero(path == 2 * k + 1)
        if not len(at):
            raise ValueError(f"token {k} got no frame")
        spans.append((int(at[0]), int(at[-1])))
    return spans


def _soft(frames) -> np.ndarray:
    x = np.array([np.asarray(f, np.float32) for f in frames], np.float32)
    if not x.size:
        return x.reshape(0, 0).astype(np.float64)
    x = x.astype(np.float64)
    x = x - x.max(1, keepdims=True)
    return (x - np.log(np.exp(x).sum(1, keepdims=True))).astype(np.float32).astype(np.float64)


def beam_search(
    rows: DataFrame, scores: str, blank: int = 0, beam: int = 8, top: int | None = None, name: str = "hypotheses",
    **bonus
) -> DataFrame:
    """Rows with their hypotheses, best first, from arrays of frames of raw scores."""

    @F.pandas_udf(HYPOTHESES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            extra = Bonus(**bonus)
            yield s.map(
                lambda frames: [
                    {
                        "token_ids": list(k), "score": v, "blank_score": b, "non_blank_score": n,
                    } for k, v, b, n in prefix_beam(_soft(frames), blank, beam, top, extra)
                ]
            )

    return rows.withColumn(name, run(F.col(scores)))


def forced_alignment(rows: DataFrame, scores: str, ids: str, blank: int = 0, name: str = "spans") -> DataFrame:
    """Rows with the span of each token in frames; an error where a row can't be aligned."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(frames: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [
                    {"start": a, "end": b} for a, b in align(_soft(f), [int(x) for x in t], blank)
                ] for f, t in zip(frames, tokens)
            ]
        )

    return rows.withColumn(name, run(F.col(scores), F.col(ids)))


def token_alignments(spans: Column, ids: Column, frontend: str = "conv2d6", shift: float = 10.0) -> Column:
    """Spans in frames and milliseconds, one for each token."""

    def entry(s: Column, t: Column) -> Column:
        first, last = frame_span(s["start"], s["end"], frontend)
        start, end = span_ms(first, last, shift)
        return F.struct(
            t.cast("int").alias("token_id"), s["start"].alias("start_encoder_t"), s["end"].alias("end_encoder_t"),
            first.cast("int").alias("start_frame"), last.cast("int").alias("end_frame"),
            start.cast("double").alias("start_ms"), end.cast("double").alias("end_ms"),
        )

    return F.zip_with(spans, ids, entry)


def debug_stats(scores: Column, blank: int) -> tuple[Column, Column]:
    """Share of frames whose best token is blank, and the mean probability of blank; 0 without frames."""
    top = F.transform(scores, lambda f: (argmax(f) == blank).cast("double"))
    prob = F.transform(scores, lambda f: F.exp(log_softmax(f)[blank]))
    mean = lambda a: F.when(
        F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a),
    ).otherwise(F.lit(0.0))
    return mean(top), mean(prob)


def rescore(
    candidates: DataFrame, group: list[str], order: str, ctc: str, length: str, decoder: str, weight: float, top: int,
) -> DataFrame:
    """Of each group's first ``top`` candidates the best by ctc / length + weight x decoder; the first of equals."""
    ranked = candidates.withColumn(
        "__n", F.row_number().over(Window.partitionBy(*group).orderBy(order)),
    ).where(F.col("__n") <= max(1, top))
    score = F.col(ctc) / F.greatest(F.lit(1), F.col(length)) + weight * F.col(decoder)
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("combined_score").desc(), "__n"))
    return ranked.withColumn("combined_score", score).withColumn("__b", best).where("__b = 1").drop("__b", "__n")


def predictions(
    rows: DataFrame, scores: str, blank: int = 0, beam: int = 8, top: int | None = None, reference: str | None = None,
    limit: int | None = None, order: str = "utt_id", eos: int | None = None, **bonus
) -> DataFrame:
    """(utt_id, pred_token_ids, ref_token_ids, score, debug): the best hypothesis of each row, of the first ``limit`` rows in
    order if one is given. With references their trailing end mark, if any, is left out, and counts stand in debug."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be 1 or more")
    chosen = rows.orderBy(order).limit(limit) if limit is not None else rows
    best = F.col("__h")[0]
    ref = F.col(reference) if reference else F.lit(None).cast("array<int>")
    if eos is not None:
        ref = F.when(F.element_at(ref, -1) == eos, F.slice(ref, 1, F.size(ref) - 1)).otherwise(ref)
    top_share, mean = debug_stats(F.col(scores), blank)
    found = beam_search(chosen, scores, blank, beam, top, "__h", **bonus)
    debug = F.struct(
        F.size(scores).alias("logit_length"), F.size(best["token_ids"]).alias("pred_token_count"), F.when(ref.isNotNull(), F.size(ref)).alias("ref_token_count"),
        top_share.alias("blank_top1_ratio"), mean.alias("avg_blank_prob"),
    )
    return found.select(
        "utt_id", best["token_ids"].alias("pred_token_ids"), ref.alias("ref_token_ids"), best["score"].alias("score"),
        debug.alias("debug"),
    )
