"""Quality classifier: interpolated modified Kneser-Ney character model of trusted text, by language.

Symbols. A text is its code points with every run of white space one space. Code points below 2048 stand for
themselves, the others for one of 2047 classes by a hash, so a symbol has 12 bits and five fit a long.

Models. There is one for each language of the trusted texts and a pooled one of them all, for documents whose
language has none. One fifth of the trusted texts, by a checksum, is held out. Each task counts the 5-grams of its
texts in numpy and Spark sums the counts. They are sharded by the two symbols before the last: an n-gram of order
3 to 5, its context and all it backs off to down to order 3 lie in one shard, where lower orders count the distinct
symbols before an n-gram. Orders 1 and 2, and the discounts D1, D2 and D3+ of every order, come from what the
shards count together: at most 4096 ** 2 pairs for a model.

Scoring by count joins. Documents are read once and packed into blocks of about ``BLOCK`` bytes of text, compressed;
beside each block stand the distinct 5-grams of its documents, by model and shard. These are joined with the counts
of their shard, where the probability of each 5-gram is worked out, and come back to their block as log
probabilities, which the documents of the block add up. A join task holds one shard of at most about ``TRAINED``
n-grams and ``ASKED`` n-grams to look up; a shard that more is asked of is dealt to several tasks. Packed texts are
written bucketed by block, so they are not shuffled at all. A document's perplexity is exp of minus the mean log
probability, where ``PRIOR`` symbols of the model's mean are added so that very short texts are not judged by chance.

Decision. The threshold is a quantile of the held-out perplexities under the model, raised by ``slack`` in the
logarithm; a document above it is rejected. Perplexities are summed up in steps of a thousandth of their
logarithm, so quantiles are exact to that and need no list of documents. There is no lower threshold: the
texts that the model was trained on are more predictable than any others, and are trusted.

Defined cases: a null language, or one without held-out trusted texts, is judged by the pooled model; null and
empty texts have no perplexity and are kept; without any held-out trusted text all is kept; texts
labelled twice are trusted only if all labels say so; rows with a null id are never trusted; repeated rows
are judged alike; whole texts are read; empty tables give empty results. All columns of the documents are
kept as they are; names of the added columns are given extra underscores where they clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import parts
from .common import settle, settle_bucketed, ship

ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
#: The model of all trusted texts; the others are named "=" and their language.
POOLED = "*"
#: Distinct n-grams of a model's shard, n-grams looked up in a shard by one task, and bytes of text in a block; about.
TRAINED, ASKED, BLOCK = 250_000, 2_000_000, 8 << 20
#: Trusted ids (8 bytes each) up to which they are broadcast instead of joined by shuffle.
IDS = 1_000_000
PRIOR = 64
QUANTILE, SLACK = 0.995, 0.05
FLUSH = 1_000_000


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(" ".join(text.split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    high = points >= 2048
    if high.any():
        points = np.where(high, 2049 + (points * 0x9E3779B1 >> 7) % 2047, points)
    return points


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """5-grams ending at each symbol of all texts, one after another, and each text's number of symbols."""
    laid, sizes = [], []
    for t in texts:
        s = symbols(t)
        sizes.append(len(s))
        laid += [np.zeros(ORDER - 1, np.int64), s]
    flat = np.concatenate(laid) if laid else np.zeros(0, np.int64)
    if len(flat) < ORDER:
        return np.zeros(0, np.int64), np.array(sizes, np.int64)
    key = flat[: len(flat) - ORDER + 1].copy()
    for k in range(1, ORDER):
        key <<= BITS
        key |= flat[k : len(flat) - ORDER + 1 + k]
    sizes = np.array(sizes, np.int64)
    # Windows that begin in one text and end in the padding of the next are left out.
    ends = np.cumsum(sizes + ORDER - 1)
    keep = np.ones(len(key), bool)
    for e in ends[:-1]:
        keep[max(0, e - ORDER + 1) : e] = False
    return key[keep], sizes


def tail(key: np.ndarray, k: int) -> np.ndarray:
    """The last k symbols of n-grams."""
    return key & ((1 << BITS * k) - 1)


def _by_model(models: list[str], texts: list[str | None]) -> Iterator[tuple[str, list[int]]]:
    rows: dict[str, list[int]] = {}
    for i, (m, t) in enumerate(zip(models, texts)):
        if t:
            rows.setdefault(m, []).append(i)
    yield from rows.items()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, back = np.unique(keys, return_inverse=True)
    return unique, np.bincount(back, counts, len(unique)).astype(np.int64)


# Training


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(model, g, c) from (model, text): counts of 5-grams, summed while they fit."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merge() -> int:
        for model, got in held.items():
            held[model] = [_summed(np.concatenate([p[0] for p in got]), np.concatenate([p[1] for p in got]))]
        return sum(len(p[0][0]) for p in held.values())

    def flush() -> Iterator[pa.RecordBatch]:
        merge()
        for model, ((keys, counts),) in held.items():
            for i in range(0, len(keys), 100_000):
                n = len(keys[i : i + 100_000])
                names = pa.array([model] * n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(keys[i : i + n]), pa.array(counts[i : i + n])], names=["model", "g", "c"],
                )
        held.clear()

    for batch in batches:
        for a, b in parts(batch.column(1)):
            models, texts = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
            for model, rows in _by_model(models, texts):
                unique, counts = np.unique(grams([texts[i] for i in rows])[0], return_counts=True)
                held.setdefault(model, []).append((unique, counts))
                size += len(unique)
            if size > FLUSH and (size := merge()) > FLUSH // 2:
                yield from flush()
                size = 0
    yield from flush()


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of 5-grams by the two symbols before the last."""
    return ((tail(key >> BITS, 2) * 0x9E3779B1) & 0xFFFFFFFF) * shards >> 32


def _shard_column(g: Column, shards: int) -> Column:
    pair = F.shiftright(g, BITS).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    return F.shiftright((pair * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(shards), 32).cast("int")


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in range(1, 5)]


def _levels(g: np.ndarray, c: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order from 5 to 2: the n-grams, sorted, with counts (of occurrences, below of distinct symbols before)."""
    levels = {ORDER: (g, c)}
    for k in range(ORDER - 1, 1, -1):
        levels[k] = np.unique(tail(levels[k + 1][0], k), return_counts=True)
    return levels


SHARD_ROWS = "model string, shard int, g binary, c binary, tallies array<long>, pairs binary, befores binary"


def _shard_row(key: tuple, group: pa.Table) -> pa.Table:
    g, c = group.column("g").to_numpy(), group.column("c").to_numpy()
    order = np.argsort(g)
    g, c = g[order], c[order]
    levels = _levels(g, c)
    pairs, befores = levels[2]
    row = {
        "model": key[0].as_py(), "shard": key[1].as_py(), "g": g.tobytes(), "c": c.tobytes(), "tallies": [
            x for k in (3, 4, 5) for x in _tally(levels[k][1])
        ],
        "pairs": pairs.tobytes(), "befores": befores.astype(np.int64).tobytes(),
    }
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.Table.from_pylist([row], schema=pa.schema(list(zip(row, kinds))))


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from how many n-grams have a count of 1, 2, 3 and 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i for i in (1, 2, 3)]
    return [min(float(i), max(0.01, d)) for i, d in enumerate(raw, 1)]


def _left(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.minimum(np.array(d)[np.minimum(counts, 3) - 1], counts)


LOWER_ROWS = "model string, cuts array<double>, one binary, weight binary, pairs binary, two binary"


def _lower_row(key: tuple, group: pa.Table) -> pa.Table:
    """Orders 1 and 2 of a model, and the discounts of orders 3 to 5, from what its shards count."""
    tallies = np.array(group.column("tallies").to_pylist(), np.int64).sum(0).reshape(3, 4).tolist()
    whole = lambda c: np.concatenate([np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()])
    pairs, counts = _summed(whole("pairs"), whole("befores"))
    singles, befores = np.unique(tail(pairs, 1), return_counts=True)
    d = _left(befores, discounts(_tally(befores)))
    one = np.full(SYMBOLS, d.sum() / befores.sum() / SYMBOLS)
    one[singles] += (befores - d) / befores.sum()
    d = _left(counts, discounts(_tally(counts)))
    context = pairs >> BITS
    total, left = np.bincount(context, counts, SYMBOLS), np.bincount(context, d, SYMBOLS)
    weight = np.divide(left, total, out=np.ones(SYMBOLS), where=total > 0)
    two = (counts - d) / total[context] + weight[context] * one[tail(pairs, 1)]
    cuts = [x for n in tallies for x in discounts(n)]
    row = {
        "model": key[0].as_py(), "cuts": cuts, "one": one.tobytes(), "weight": weight.tobytes(),
        "pairs": pairs.tobytes(), "two": two.tobytes(),
    }
    kinds = [pa.string(), pa.list_(pa.float64()), *[pa.binary()] * 4]
    return pa.Table.from_pylist([row], schema=pa.schema(list(zip(row, kinds))))


def train(texts: DataFrame) -> tuple[DataFrame, int]:
    """The shards of all models from texts (lang, text), a row each, and the number of shards that a model has."""
    ship(texts.sparkSession)
    named = texts.select(
        F.concat(F.lit("="), F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("model"), "text",
    )
    counted = settle(
        named.mapInArrow(_count, "model string, g long, c long").groupBy("model", "g").agg(F.sum("c").alias("c"))
    )
    shards = max(1, -(-counted.count() // TRAINED))
    pooled = counted.groupBy("g").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("model"), "g", "c")
    dealt = counted.union(pooled).withColumn("shard", _shard_column(F.col("g"), shards))
    rows = settle(dealt.groupBy("model", "shard").applyInArrow(_shard_row, SHARD_ROWS))
    lower = settle(
        rows.select("model", "tallies", "pairs", "befores").groupBy("model").applyInArrow(_lower_row, LOWER_ROWS)
    )
    # A shard without n-grams of a model still has the model's lower orders.
    every = lower.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return settle(every.join(rows.drop("tallies", "pairs", "befores"), ["model", "shard"], "left")), shards


class Shard:
    """Probabilities of the 5-grams of one shard of a model."""

    def __init__(self, row: dict):
        of = lambda c, kind: np.frombuffer(row[c] or b"", kind)
        self.one, self.weight, self.pairs, self.two = of("one", float), of("weight", float), of("pairs", np.int64), of("two", float)
        self.orders = []
        levels = _levels(of("g", np.int64), of("c", np.int64))
        for k in range(3, ORDER + 1) if row["g"] else ():
            g, c = levels[k]
            d = _left(c, row["cuts"][3 * (k - 3) : 3 * (k - 2)])
            context, first, at = np.unique(g >> BITS, return_index=True, return_inverse=True)
            total = np.add.reduceat(c, first)
            self.orders.append((k, g, (c - d) / total[at], context, np.add.reduceat(d, first) / total))

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each 5-gram."""

        def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return at, keys[at] == wanted

        p = self.weight[tail(key >> BITS, 1)] * self.one[tail(key, 1)]
        at, seen = find(self.pairs, tail(key, 2))
        p = np.where(seen, self.two[at], p)
        for k, g, share, context, weight in self.orders:
            mine = tail(key, k)
            at, known = find(context, mine >> BITS)
            p = np.where(known, weight[at] * p, p)
            at, seen = find(g, mine)
            p += np.where(seen, share[at], 0.0)
        return np.log(p)


# Scoring


_CODEC = pa.Codec("zstd", compression_level=9)
_FAST = pa.Codec("zstd", compression_level=1)
PACKED = "block string, model string, shard int, n long, keys binary, texts binary"


def _pack(batches: Iterator[pa.RecordBatch], model_at: int, text_at: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: pieces of a block's rows, compressed, a row each, and one row for the distinct 5-grams of each model and shard."""
    schema = pa.schema(
        [
            ("block", pa.string()), ("model", pa.string()), ("shard", pa.int32()), ("n", pa.int64()),
            ("keys", pa.binary()), ("texts", pa.binary()),
        ]
    )
    task, number, size = TaskContext.get().partitionId(), 0, 0
    met: dict[str, list[np.ndarray]] = {}

    def made(*rows: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        for model, got in met.items():
            keys = np.unique(np.concatenate(got))
            shard = shard_of(keys, shards)
            for s in np.unique(shard).tolist():
                mine = keys[shard == s]
                yield made(
                    (
                        f"{task}.{number}", model, s, len(mine),
                        _FAST.compress(np.diff(mine, prepend=0).tobytes(), asbytes=True), None,
                    )
                )
        number, size = number + 1, 0
        met.clear()

    for batch in batches:
        for a, b in parts(batch.column(text_at)):
            part = batch.slice(a, b - a)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
                out.write_batch(part)
            yield made((f"{task}.{number}", None, None, None, None, sink.getvalue().to_pybytes()))
            size += part.nbytes
            models, texts = part.column(model_at).to_pylist(), part.column(text_at).to_pylist()
            for model, rows in _by_model(models, texts):
                met.setdefault(model, []).append(np.unique(grams([texts[i] for i in rows])[0]))
            if size > BLOCK:
                yield from flush()
    yield from flush()


def _keys(row: dict) -> np.ndarray:
    return np.cumsum(np.frombuffer(_FAST.decompress(row["keys"], 8 * row["n"]), np.int64))


ANSWERS = "block string, model string, n long, keys binary, logs binary"


def _answer(asked: pa.Table, trained: pa.Table) -> pa.Table:
    rows = asked.select(["block", "model", "n", "keys"]).to_pylist()
    if rows:
        shard = Shard(trained.to_pylist()[0])
        keys = [_keys(r) for r in rows]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        logs = np.split(shard(distinct).astype(np.float32)[back], np.cumsum([len(k) for k in keys])[:-1])
        for row, mine in zip(rows, logs):
            row["logs"] = mine.tobytes()
    kinds = [
        ("block", pa.string()), ("model", pa.string()), ("n", pa.int64()), ("keys", pa.binary()), ("logs", pa.binary()),
    ]
    return pa.Table.from_pylist(rows, schema=pa.schema(kinds))


def _add_up(
    packed: pa.Table, answers: pa.Table, added: list[tuple[str, pa.DataType]], model_at: int, text_at: int,
) -> pa.Table:
    """The rows of a block with the sum of log probabilities of each text and its number of symbols."""
    got: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for row in answers.to_pylist():
        got.setdefault(row["model"], []).append((_keys(row), np.frombuffer(row["logs"], np.float32)))
    tables = {}
    for model, shares in got.items():
        keys = np.concatenate([k for k, _ in shares])
        order = np.argsort(keys)
        tables[model] = keys[order], np.concatenate([x for _, x in shares])[order].astype(float)
    done = []
    for piece in packed.column("texts"):
        for batch in pa.ipc.open_stream(piece.as_buffer()):
            models, texts = batch.column(model_at).to_pylist(), batch.column(text_at).to_pylist()
            sums, counts = [0.0] * len(texts), [0] * len(texts)
            for model, rows in _by_model(models, texts):
                key, sizes = grams([texts[i] for i in rows])
                distinct, back = np.unique(key, return_inverse=True)
                keys, logs = tables[model]
                run = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(keys, distinct)][back])])
                ends = np.cumsum(sizes)
                for i, a, b in zip(rows, (ends - sizes).tolist(), ends.tolist()):
                    sums[i], counts[i] = float(run[b] - run[a]), b - a
            schema = pa.schema([*batch.schema, *map(pa.field, *zip(*added))])
            done.append(
                pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(sums, pa.float64()), pa.array(counts, pa.int64())], schema=schema,
                )
            )
    return pa.Table.from_batches(done)


def score(
    rows: DataFrame, trained: DataFrame, shards: int, model_col: str, text_col: str, total: str, count: str,
) -> DataFrame:
    """rows with two columns more: the sum of log probabilities under the row's model and the number of symbols."""
    spark = rows.sparkSession
    ship(spark)
    model_at, text_at = rows.columns.index(model_col), rows.columns.index(text_col)
    out = rows.withColumns({total: F.lit(0.0), count: F.lit(0).cast("long")}).schema
    packed = settle_bucketed(
        rows.mapInArrow(lambda batches: _pack(batches, model_at, text_at, shards), PACKED), "block",
    )
    asked = packed.where("shard is not null").select("block", "model", "shard", "n", "keys")
    # One row for each shard of each model: Spark broadcasts it by its size or joins by shuffle.
    tasks = settle(asked.groupBy("model", "shard").agg(F.ceil(F.sum("n") / ASKED).cast("int").alias("tasks")))
    dealt = asked.join(tasks, ["model", "shard"]).withColumn(
        "task", F.pmod(F.xxhash64("block"), F.col("tasks")).cast("int"),
    ).drop("tasks")
    side = trained.join(tasks, ["model", "shard"]).withColumn(
        "task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)),
    ).drop("tasks")
    met = ["model", "shard", "task"]
    answers = dealt.groupBy(*met).cogroup(side.groupBy(*met)).applyInArrow(_answer, ANSWERS)
    blocks = packed.where("texts is not null").select("block", "texts")
    join = lambda a, b: _add_up(a, b, [(total, pa.float64()), (count, pa.int64())], model_at, text_at)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, out)


# Trusted texts, thresholds, judgement


def trusted_texts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """(lang, text, held) of documents whose labels all say quality 1 and not toxic."""
    ids = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    ids = settle(
        ids.agg(
            F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"),
        ).where("q = 1 and t = 0").select("__id")
    )
    few = ids.count() <= IDS
    texts = docs.select(
        F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
    )
    held = (F.crc32(F.encode("text", "UTF-8")) % 5 == 0).alias("held")
    found = texts.where(F.length("text") > 0).join(
        F.broadcast(ids) if few else ids, "__id", "left_semi",
    ).select("lang", "text", held)
    return found if few else settle(found)


def _log_perplexity(total: str, count: str, mean: Column) -> Column:
    return (-F.col(total) + PRIOR * mean) / (F.col(count) + PRIOR)


def thresholds(scored: DataFrame, quantile: float, slack: float) -> DataFrame:
    """(model, mean, high) in log perplexity, from scored held-out texts (model, total, count)."""
    scored = scored.where("count > 0")
    means = scored.groupBy("model").agg((-F.sum("total") / F.sum("count")).alias("mean"))
    binned = scored.join(means, "model").select(
        "model", "mean", F.floor(_log_perplexity("total", "count", F.col("mean")) * 1000).alias("bin"),
    )
    counts = binned.groupBy("model", "mean", "bin").agg(F.count("*").alias("n"))
    # At most some ten thousand bins for each model, whatever the number of documents.
    upto = F.sum("n").over(Window.partitionBy("model").orderBy("bin"))
    every = F.sum("n").over(Window.partitionBy("model"))
    ranked = counts.select("model", "mean", "bin", (upto / every).alias("share"))
    return ranked.groupBy("model", "mean").agg(
        ((F.min(F.when(F.col("share") >= quantile, F.col("bin"))) + 1) / 1000 + slack).alias("high")
    )


def fresh(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", quantile: float = QUANTILE, slack: float = SLACK
) -> tuple[DataFrame, str, str]:
    """docs with the columns perplexity and keep, and these columns' names (longer where they clash)."""
    texts = trusted_texts(docs, labels, id_col, lang_col, text_col)
    trained, shards = train(texts.where("not held"))
    # A language takes part if it has both training and held-out texts; the pooled model judges the others.
    named = F.concat(F.lit("="), F.coalesce(F.col("lang"), F.lit("")))
    models = trained.select("model").distinct()
    held = texts.where("held").select(
        F.explode(F.array(named, F.lit(POOLED))).alias("model"), "text",
    ).join(F.broadcast(models), "model", "left_semi")
    scored = settle(score(held, trained, shards, "model", "text", "total", "count").select("model", "total", "count"))
    limits = settle(thresholds(scored, quantile, slack))
    own, mean, high, total, count = (fresh(docs, f"__{c}") for c in ("model", "mean", "high", "total", "count"))
    perplexity, keep = fresh(docs, "perplexity"), fresh(docs, "keep")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    # One row for each language of trusted texts: Spark broadcasts it by its size or joins by shuffle.
    known = limits.select(F.col("model").alias(own))
    lang = F.concat(F.lit("="), F.col(f"`{lang_col}`").cast("string"))
    judged = score(
        docs.join(known, lang == known[own], "left").withColumn(own, F.coalesce(own, F.lit(POOLED))), trained, shards,
        own, text_col, total, count,
    ) if not limits.isEmpty() else None
    if judged is None:
        return docs.select(
            *kept, F.lit(None).cast("double").alias(perplexity), F.lit(True).alias(keep),
        ), perplexity, keep
    told = judged.join(limits.toDF(own, mean, high), own, "left")
    log_p = F.when(F.col(count) > 0, _log_perplexity(total, count, F.col(mean)))
    return told.select(
        *kept, F.exp(log_p).alias(perplexity), F.coalesce(log_p <= F.col(high), F.lit(True)).alias(keep),
    ), perplexity, keep
