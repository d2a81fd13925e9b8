"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte values that separate words: space and the controls from tab to carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
#: Rows and bytes of an Arrow batch: Spark's own bounds of 10,000 and 64 MB are much for a worker that makes several rows or forms of each.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304")}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they share that folder; bound the session's Arrow batches."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".rstrip(":")
    for name, (default, ours) in BATCH.items():
        if spark.conf.get(name) == default:  # a session's own choice stands
            spark.conf.set(name, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, through Spark's own reader so any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and runs on one machine (a test) a temporary folder is chosen
    and set, so that later calls agree; on a cluster that would lose rows, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="talweg-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders by the column ``by`` if given, and read it back.

    This cuts the lineage and survives lost executors; unlike ``checkpoint()`` the files are
    columnar and compressed. Each call takes a folder of its own, which the owner of the shared
    folder clears like any checkpoint, unless ``discard`` removes it before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``materialize`` that no plan reads any more, and let Spark drop shuffles of finished jobs."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """Deal rows by key to at least ``n`` partitions, more where the session is wider."""
    return df.repartition(max(n, shuffle_width(df.sparkSession)), *keys)


def text_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` as UTF-8 binary; a null text becomes empty."""
    ship(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text"))


def one_thread() -> None:
    """Executors give each task one core: keep native libraries from starting more threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so once their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if the table has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken or f"{name}_p" in taken:
        name += "_"
    return name
