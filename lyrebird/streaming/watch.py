"""Watching for results, and batching a stream with state that lives across micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.batching import Batcher


def watch_json(
    spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str,
    once: bool = True, every: str = "30 seconds", min_age: str | None = None,
):
    """Call ``handle(rows, batch)`` for files that appear under a folder. The checkpoint remembers what was handled, so a
    restart goes on where it stopped; ``handle`` should overwrite by key, since its last call may come again."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(folder)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _versions(spark: SparkSession, target: str) -> tuple[Any, Any, list[int]]:
    """The file system and path of a folder of versions, and the numbers of those that are complete."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    found = files.globStatus(context._jvm.org.apache.hadoop.fs.Path(path, "version=*/_SUCCESS")) or []
    return files, path, sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found)


def latest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """What ``upsert`` has kept, of the newest complete version (below ``before``); none if there is none."""
    numbers = [n for n in _versions(spark, target)[2] if before is None or n < before]
    return spark.read.parquet(f"{target}/version={numbers[-1]}").drop("__batch") if numbers else None


def upsert(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """A handler that keeps one row for each key, the newest, as versions of a Parquet folder of small results. A batch
    writes a version of its own from the one before it, so one that is cut off or comes again loses nothing."""

    def handle(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        files, path, numbers = _versions(spark, target)
        earlier = [n for n in numbers if n < batch]
        new = rows.withColumn("__batch", F.lit(batch))
        if earlier:
            new = spark.read.parquet(f"{target}/version={earlier[-1]}").unionByName(new, allowMissingColumns=True)
        newest = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), "__batch").alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{target}/version={batch}")
        for old in earlier[:-1]:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"version={old}"), True)

    return handle


def paired_stream(
    audio: DataFrame, meta: DataFrame, keys: list[str], time: str, within: str = "10 minutes",
) -> DataFrame:
    """Stream-stream join of members on their keys; a member waits for its partner no longer than ``within``."""
    a, m = audio.withWatermark(time, within).alias("a"), meta.withWatermark(time, within).alias("m")
    on = F.expr(
        " AND ".join(
            f"a.{k} = m.{k}" for k in keys
        ) + f" AND m.{time} BETWEEN a.{time} - INTERVAL {within} AND a.{time} + INTERVAL {within}"
    )
    return a.join(m, on).select("a.*", *[F.col(f"m.{c}") for c in meta.columns if c not in keys and c != time])


def batch_stream(
    rows: DataFrame, key: str, order: str, frames: str, text: str, budget: int | None, most: int,
    skip_oversized: bool = True,
) -> DataFrame:
    """(key, order, frames, text, batch): greedy batches over each key's stream, carried over from one micro-batch to the next."""
    batcher = Batcher(budget, most, skip_oversized)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(k: tuple[Any, ...], frames_iter: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0, 0, 0)
        df = pd.concat(list(frames_iter)).sort_values(order)
        out = []
        for o, f, t in zip(df[order], df[frames], df[text]):
            held, batch = batcher.step(tuple(held), int(f), int(t))
            if batch is not None:
                out.append((k[0], o, f, t, batch))
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=[key, order, frames, text, "batch"])

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {frames} {kinds[frames]}, {text} {kinds[text]}, batch long"
    return rows.groupBy(key).applyInPandasWithState(
        run, schema, "batch long, n long, longest long, words long", "append", GroupStateTimeout.NoTimeout,
    )
