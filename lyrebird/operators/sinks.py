"""Writers: length indexes, bucket parts, summaries, predictions, previews, metric files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.frames import format_number
from ..schemas import LENGTH_ENTRY
from .batching import places
from .index import numbered


def write_length_index(entries: DataFrame, path: str) -> None:
    """JSON lines in source order within each part; parts follow the shards."""
    entries.repartitionByRange("shard_name").sortWithinPartitions("shard_name", "audio_offset").write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def write_bucket_parts(
    entries: DataFrame, path: str, frames: str = "num_frames", width: int = 80, entries_per_part: int = 100_000,
) -> DataFrame:
    """Folders split=/bucket_id=/part= with the entries in source order; the folder is written anew. Gives one row for each
    part, with its folder, samples, first and last shard, as read back from what was written."""
    bucketed = entries.withColumn("bucket_id", F.floor(F.col(frames) / width).cast("int"))
    keys = ["split", "bucket_id", "part"]
    parts = numbered(
        bucketed, keys[:2], [F.col("shard_name"), F.col("audio_offset")],
    ).withColumn("part", F.floor(F.col("ordinal") / entries_per_part).cast("int"))
    sorted_ = parts.repartition(*keys).sortWithinPartitions(*keys, "shard_name", "audio_offset")
    sorted_.drop("ordinal").write.partitionBy(*keys).option("ignoreNullFields", "false").mode("overwrite").json(path)
    spark = entries.sparkSession
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.col(k)) for k in keys])
    written = spark.read.schema(
        f"{LENGTH_ENTRY}, split string, bucket_id int, part int".replace("split string, ", "", 1)
    ).json(path)
    return written.groupBy(*keys).agg(
        F.count("*").alias("num_samples"), F.min("shard_name").alias("first_shard"),
        F.max("shard_name").alias("last_shard"),
    ).withColumn("path", folder)


def bucket_document(
    parts: DataFrame, root: str, source: str, width: int = 80, entries_per_part: int = 100_000,
) -> DataFrame:
    """One row, the manifest of written parts: by split, its buckets in order with their parts. A row for each part is
    all that is gathered."""
    part = F.struct("path", "num_samples", "first_shard", "last_shard")
    listed = parts.groupBy("split", "bucket_id").agg(
        F.sum("num_samples").alias("n"), F.array_sort(F.collect_list(F.struct("part", part.alias("p")))).alias("x"),
    )
    bucket = F.struct("bucket_id", F.col("n").alias("num_samples"), F.transform("x", lambda v: v["p"]).alias("parts"))
    by_split = listed.groupBy("split").agg(
        F.sum("n").alias("num_samples"), F.array_sort(F.collect_list(bucket)).alias("buckets"),
    )
    splits = by_split.agg(
        F.map_from_entries(F.collect_list(F.struct("split", F.struct("num_samples", "buckets")))).alias("splits")
    )
    head = {
        "version": 1, "root": root, "source_length_index_path": source, "bucket_width": width,
        "entries_per_part": entries_per_part,
    }
    return splits.select(*[F.lit(v).alias(k) for k, v in head.items()], "splits")


def write_buckets(
    entries: DataFrame, folder: str, root: str, source: str, frames: str = "num_frames", width: int = 80,
    entries_per_part: int = 100_000,
) -> None:
    """Bucket parts and, beside them, ``manifest.json``, which ``sources.manifests.bucket_manifest`` reads."""
    parts = write_bucket_parts(entries, f"{folder}/parts", frames, width, entries_per_part)
    named = parts.withColumn("path", F.concat(F.lit("parts/"), "path"))
    write_document(bucket_document(named, root, source, width, entries_per_part), f"{folder}/manifest.json")


def write_document(one_row: DataFrame, path: str) -> None:
    """One row as an indented JSON document, written by the driver to whatever file system the path is in."""
    text = one_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
    context = one_row.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(json.dumps(json.loads(text), ensure_ascii=False, indent=2).encode())
    finally:
        out.close()


def paired(first: DataFrame, second: DataFrame, key: str, place: str) -> DataFrame:
    """Two outputs of one job side by side by their place; of different length, or with different keys, they are an error."""
    other = second.select(
        F.col(place), F.col(key).alias("__key"),
        *[c for c in second.columns if c not in (key, place) and c not in first.columns]
    )
    both = first.withColumn("__a", F.lit(True)).join(other, place, "full")
    wrong = F.col("__a").isNull() | F.col("__key").isNull() | (F.col("__key") != F.col(key))
    return both.withColumn(
        key, F.when(wrong, F.raise_error(F.lit("the two outputs do not fit together"))).otherwise(F.col(key)),
    ).drop("__a", "__key")


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def preview(rows: DataFrame, order: str, n: int) -> DataFrame:
    """(place, value): the first n rows as text blocks for reading, from 1."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    rescored = F.coalesce("ctc_score", "decoder_score", "combined_score").isNotNull()
    # The labels of a block, which preview readers look for.
    debug = {
        "feat": "feature_length", "logit": "logit_length", "pred_tok": "pred_token_count", "ref_tok": "ref_token_count",
        "blank_top1": "blank_top1_ratio", "avg_blank": "avg_blank_prob",
    }
    labels = {"ctc": "ctc_score", "decoder": "decoder_score", "combined": "combined_score"}
    numbers = [
        F.concat(
            F.lit(f"{k}="),
            format_number(F.col(f"debug.{c}"), 3) if c[-1] in "ob" else F.col(f"debug.{c}").cast("string"),
        ) for k, c in debug.items()
    ]
    lines = [
        F.concat(F.lit("["), F.col("place"), F.lit("] utt_id="), text("utt_id")),
        F.concat(F.lit("  REF : "), text("ref_text")),
        F.concat(F.lit("  PRED: "), text("pred_text")),
        F.concat(F.lit("  SCORE: "), format_number(F.col("score"), 4)),
        F.when(F.col("decode_strategy") != "ctc", F.concat(F.lit("  STRATEGY: "), "decode_strategy")),
        F.when(
            rescored,
            F.concat_ws(" ", F.lit("  RESCORE:"), *[F.concat(F.lit(f"{k}="), shown(c)) for k, c in labels.items()]),
        ),
        F.when(F.col("debug").isNotNull(), F.concat_ws(" ", F.lit("  DEBUG:"), *numbers)),
    ]
    first = rows.orderBy(order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(order)))
    return first.select("place", F.concat_ws("\n", *lines).alias("value"))


def write_preview(rows: DataFrame, path: str, order: str, n: int) -> None:
    """A preview as one text file in the order of its blocks."""
    preview(rows, order, n).orderBy("place").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_yaml(records: DataFrame, path: str, key: str, order: list[str], keep: int | None = None) -> None:
    """A history of metrics, a few rows, with the best of them."""
    import yaml

    rows = [r.asDict() for r in records.orderBy(*order).collect()]
    doc = {key: rows}
    if keep is not None:
        doc |= {"best": sorted(rows, key=lambda r: (r["eval_loss"], r["step"]))[: max(1, keep)], "keep_top_k": keep}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(doc, f, sort_keys=False)


def range_of(rows: DataFrame, order: str, ranges: int = 256) -> Column:
    """The range that a value of ``order`` lies in, rising with it. Ranges are of about equal size for numbers, dates and
    times: at most ``ranges`` quantiles reach the driver. Strings go by their first characters."""
    kind = rows.schema[order].dataType
    if isinstance(kind, StringType):
        return F.substring(order, 1, 3)
    quantiles = F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000)
    cuts = rows.agg(quantiles.alias("q")).first()["q"] or []
    return F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c <= F.col(order))) if cuts else F.lit(0)


def export_parts(rows: DataFrame, order: str, size: int, scores: str, ranges: int = 256) -> tuple[DataFrame, DataFrame]:
    """Rows with part_index, and the index: rows, longest and vocabulary of each part. ``order`` is a number, a date or
    a time, or a string: rows are numbered within ranges of it and moved by what lies before, not in one task."""
    parts = places(rows.withColumn("__range", range_of(rows, order, ranges)), [], "__range", [order])
    parts = parts.withColumn("part_index", F.floor(F.col("place") / size).cast("int")).drop("place", "__range")
    index = parts.groupBy("part_index").agg(
        F.count("*").alias("num_rows"), F.max(F.size(scores)).alias("max_time"),
        F.max(F.size(F.get(F.col(scores), F.lit(0)))).alias("vocab_size"),
    )
    return parts, index
