"""Tar shards as a Python data source: one partition for each shard, headers alone unless the payload is asked for.

``spark.dataSource.register(TarShards)``, then ``spark.read.format("tarshard").load(path)``. Options: ``pattern``
(``*.tar``), ``payload`` (``true`` reads members' bytes), ``suffixes``. Files are opened by the workers, so the
path must be one that all of them see; other stores come through ``members_of``, over Spark's binaryFile.
"""

from __future__ import annotations

import glob
import io
import os
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas

SUFFIXES = ("json", "wav", "mp3", "flac")
MEMBER = re.compile(r"([^/]*)\.([^./]*)$")


def member_name(name: str, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[str, str] | None:
    """(key, lower-case suffix) of a member, null for other files."""
    m = MEMBER.search(name)
    return (m[1], m[2].lower()) if m and m[2].lower() in suffixes else None


def list_shards(path: str, pattern: str = "*.tar") -> list[str]:
    found = [path] if os.path.isfile(path) else sorted(glob.glob(os.path.join(path, pattern)))
    if not found:
        raise FileNotFoundError(f"no shards {pattern} under {path}")
    return found


def scan(file, shard: str, payload: bool, suffixes: tuple[str, ...] = SUFFIXES) -> Iterator[tuple]:
    with tarfile.open(fileobj=file, mode="r:") as archive:
        for m in archive:
            named = member_name(m.name, suffixes) if m.isreg() else None
            if named:
                yield (shard, m.name, *named, m.offset_data, m.size, archive.extractfile(m).read() if payload else None)


class _Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.shards = list_shards(options["path"], options.get("pattern", "*.tar"))
        self.payload = str(options.get("payload", "false")).lower() == "true"
        self.suffixes = tuple(options.get("suffixes", ",".join(SUFFIXES)).split(","))

    def partitions(self):
        return [_Shard(p) for p in self.shards]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from scan(f, os.path.basename(partition.path), self.payload, self.suffixes)


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarshard"

    def schema(self) -> str:
        return schemas.TAR_MEMBER

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def members_of(spark: SparkSession, path: str, pattern: str = "*.tar", payload: bool = False) -> DataFrame:
    """The same rows by Spark's own reader, for stores that workers can't open. A shard's bytes are in memory at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schemas.TAR_MEMBER.split(", ")]
        for df in batches:
            for p, content in zip(df["path"], df["content"]):
                yield pd.DataFrame(list(scan(io.BytesIO(content), p.rpartition("/")[2], payload)), columns=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(run, schemas.TAR_MEMBER)


def read_members(
    index: DataFrame, folder: str, shard: str = "shard_name", offset: str = "audio_offset", size: str = "audio_size",
    member: str = "audio_member", name: str = "payload",
) -> DataFrame:
    """Rows of a length index with their members' bytes: shards together and offsets in order, one open file at a time. A
    missing offset is looked up by the member's name; a short read is an error."""
    schema = index.schema.add(name, "binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, file, names = None, None, {}
        for df in batches:
            out = []
            for s, o, n, m in zip(df[shard], df[offset], df[size], df[member]):
                if s != held:
                    if file:
                        file.close()
                    held, file, names = s, open(os.path.join(folder, s), "rb"), {}
                if pd.isna(o) or pd.isna(n):
                    if not names:
                        with tarfile.open(fileobj=file, mode="r:") as archive:
                            names = {x.name: (x.offset_data, x.size) for x in archive}
                    o, n = names[m]
                file.seek(int(o))
                got = file.read(int(n))
                if len(got) != int(n):
                    raise EOFError(f"{s} ends within {m}")
                out.append(got)
            yield df.assign(**{name: out})
        if file:
            file.close()

    return index.repartition(F.col(shard)).sortWithinPartitions(shard, offset).mapInPandas(run, schema)


def pair(members: DataFrame) -> DataFrame:
    """Samples with an audio and a JSON member each, where keys are unique in a shard."""
    audio = members.where("suffix <> 'json'").select(
        "shard_name", "key", F.col("member").alias("audio_member"), F.col("suffix").alias("audio_format"),
        F.col("offset").alias("audio_offset"), F.col("size").alias("audio_size"),
    )
    meta = members.where("suffix = 'json'").select(
        "shard_name", "key", F.col("member").alias("json_member"), F.col("offset").alias("json_offset"),
        F.col("size").alias("json_size"), F.col("payload").cast("string").alias("metadata"),
    )
    return audio.join(meta, ["shard_name", "key"])


def length_entries(members: DataFrame, rule, utt_id_key: str | None = None) -> DataFrame:
    """Length entries of a scan with payloads: ids, splits and frames from the members' metadata."""
    from ..functions.frames import infer_frames
    from ..functions.splits import sample_id

    field = lambda n: F.get_json_object("metadata", f"$.{n}")
    paired = pair(members).withColumn("utt_id", sample_id(field(utt_id_key or rule.id_field), F.col("key")))
    frames = infer_frames(
        field("num_frames"), field("begin_time"), field("end_time"), field("duration"), field("num_samples"),
        field("sample_rate"),
    )
    side = rule.side(rule.key(F.col("utt_id"), F.col("shard_name")))
    return paired.select(
        "shard_name", "key", "utt_id", side.alias("split"), frames.alias("num_frames"), "audio_member", "audio_format",
        "json_member", "audio_offset", "audio_size", "json_offset", "json_size",
    )
