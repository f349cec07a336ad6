"""JSON and text sources: manifests, length indexes, bucket manifests, predictions, sidecars, corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.frames import bucket_id  # noqa: F401
from ..functions.text import SPACE, key_values, language_code, step_number


def _truthy(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def _required(value: Column, message: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def resolve(path: Column, folder: str) -> Column:
    return F.when(
        path.startswith("/") | path.rlike("^[a-z][a-z0-9+.-]*://"), path,
    ).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))


def manifest(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Labelled manifest: an id by utt_id, id or audio_id (empty ones fall through), and token_ids or text; errors otherwise."""
    raw = spark.read.schema(schemas.MANIFEST).json(path)
    base = folder if folder is not None else path.rpartition("/")[0]
    utt = _required(F.coalesce(_truthy("utt_id"), _truthy("id"), _truthy("audio_id")), "a manifest row has no id")
    has = F.col("token_ids").isNotNull() | F.col("text").isNotNull()
    return raw.select(
        F.when(has, utt).otherwise(
            F.raise_error(F.lit("a manifest row has neither token_ids nor text")).cast("string")
        ).alias("utt_id"), "token_ids", "text",
        resolve(F.col("feature_path"), base).alias("feature_path"), resolve(
            F.col("audio_filepath"), base,
        ).alias("audio_filepath"), "num_frames",
    )


def unlabelled_manifest(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    raw = spark.read.schema(schemas.MANIFEST).json(path)
    base = folder if folder is not None else path.rpartition("/")[0]
    utt = _required(F.coalesce(_truthy("utt_id"), _truthy("id"), _truthy("audio_id")), "a manifest row has no id")
    has = F.coalesce(_truthy("feature_path"), _truthy("audio_filepath")).isNotNull()
    return raw.select(
        F.when(has, utt).otherwise(
            F.raise_error(F.lit("a manifest row has neither features nor audio")).cast("string")
        ).alias("utt_id"),
        resolve(F.col("feature_path"), base).alias("feature_path"), resolve(
            F.col("audio_filepath"), base,
        ).alias("audio_filepath"),
    )


def length_index(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Length entries; the older wav_member is the audio member, the format follows from its name."""
    raw = spark.read.schema(schemas.LENGTH_ENTRY).json(path)
    member = F.coalesce("audio_member", "wav_member")
    fmt = F.coalesce("audio_format", F.nullif(F.lower(F.regexp_extract(member, "\\.([^./]*)$", 1)), F.lit("")))
    rows = raw.withColumns({"audio_member": member, "audio_format": fmt}).drop("wav_member")
    return rows if split in (None, "all") else rows.where(F.col("split") == split)


def bucket_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, bucket_id, num_samples, parts, ...) by bucket."""
    raw = spark.read.schema(schemas.BUCKET_MANIFEST).option("multiLine", True).json(path)
    each = raw.select("root", "bucket_width", "entries_per_part", F.explode("splits").alias("split", "s"))
    return each.select(
        "root", "bucket_width", "entries_per_part", "split", F.inline("s.buckets"),
    ).orderBy("split", "bucket_id")


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object as one row; anything else is an error."""
    df = spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in df.columns or len(df.take(2)) != 1:
        raise ValueError(f"{path} holds no JSON object")
    return df


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction rows; a missing file gives none."""
    try:
        return spark.read.schema(schemas.PREDICTION).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.PREDICTION)


def utterance_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a sidecar: plain lines or JSON objects."""
    s = F.regexp_replace(F.col("value"), f"^{SPACE}+|{SPACE}+$", "")
    field = lambda n: F.nullif(F.get_json_object(s, f"$.{n}"), F.lit(""))
    got = F.when(s.startswith("{"), F.coalesce(field("utt_id"), field("id"), field("audio_id"))).otherwise(s)
    return spark.read.text(path).where(s != "").select(got.alias("utt_id"))


def preview_lines(spark: SparkSession, path: str, signed: bool = False) -> DataFrame:
    """(path, values): the key=number pairs of DEBUG lines."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.where(F.col("value").startswith("  DEBUG:")).select(
        "path", key_values(F.col("value"), signed).alias("values"),
    )


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(lang, file, line): stripped, non-empty lines of text files, by the language that a file's name begins with."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", f"^{SPACE}+|{SPACE}+$", "").alias("line"),
    )
    return rows.where(F.col("line") != "").select(language_code(F.col("file")).alias("lang"), "file", "line")


def checkpoints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, step) by step; names without a step come first with -1. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(
        "path", F.col("modificationTime").alias("modified"),
    )
    return files.withColumn("step", step_number(F.col("path"))).orderBy("step", "path")


def evaluation_parquet(spark: SparkSession, folder: str, pattern: str = "test-*.parquet") -> DataFrame:
    return spark.read.option("pathGlobFilter", pattern).parquet(folder).select("name", "text", "audio")


def yaml_records(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Records of a YAML file of metrics; none where the file or the list is missing or of another shape."""
    import os

    import yaml

    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f)
    rows = doc.get(key) if isinstance(doc, dict) else None
    names = [x.strip().split()[0] for x in schema.split(",")]
    good = [tuple(r.get(n) for n in names) for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
    return spark.createDataFrame(good, schema)


def one_source(manifest_path: str | None, shards_path: str | None) -> str:
    if bool(manifest_path) == bool(shards_path):
        raise ValueError("give a manifest or shards, and not both")
    return "manifest" if manifest_path else "shards"
