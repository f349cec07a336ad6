"""What the operators of this subpackage share: settled tables, the workers' import path, table reading."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever file system Spark resolves the path with."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting of rows in an Arrow batch, its default, and what is set instead: rows here are whole texts, and a batch
#: is held several times over by executors and workers.
BATCH, USUAL, FEWER = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even when the driver was started in another folder, and keep Arrow batches
    small, unless the session says how large they are to be."""
    if spark.conf.get(BATCH) == USUAL:
        spark.conf.set(BATCH, FEWER)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset, and on one machine only (tests): a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lyrebird-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_swept: set[str] = set()


def _place(spark: SparkSession) -> str:
    """A path of its own in this application's part of the shared folder, which is deleted when the driver's Python ends."""
    name = spark.sparkContext.applicationId
    if name not in _swept:
        _swept.add(name)
        atexit.register(lambda: sweep(spark) if spark.sparkContext._jsc else None)
    return f"{shared_folder(spark)}/lyrebird-{name}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: whatever executor is lost later, the table is not computed again. Unlike
    ``checkpoint()`` it computes its input once, not twice. ``sweep`` deletes what a session has written, at the
    latest when the driver's Python ends.
    """
    spark = df.sparkSession
    path = _place(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, key: str) -> DataFrame:
    """``settle`` that deals the files into buckets by ``key``, as many as shuffles have partitions: what groups or joins
    the result by it moves no row of it. The table is in the catalog only until it is read."""
    spark = df.sparkSession
    path = _place(spark)
    name = f"spark_catalog.default.lyrebird_{path[-32:]}"
    buckets = min(
        conf_int(spark, "spark.sql.shuffle.partitions", 200),
        conf_int(spark, "spark.sql.sources.bucketing.maxBuckets", 100_000),
    )
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the name goes; an external table's files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def sweep(spark: SparkSession) -> None:
    """Delete every settled table of this application; results that still read them become unusable."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lyrebird-{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))
