"""What every operator needs of the session: importable workers, joins by measured sizes and a shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def by_measure(spark: SparkSession) -> None:
    """Let only measured sizes choose broadcasts, up to the session's own bound.

    Spark's estimate before a run is the size of the files read, which are compressed and don't tell how many vertices or faces
    come of a row: tables of a million rows count as a few MB, and several of them at once are more than the driver holds.
    """
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if bound.startswith("-"):
        return
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", bound)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they share that folder; let measured sizes choose broadcasts."""
    by_measure(spark)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".rstrip(":")


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


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder, in folders by the column ``by`` if given, and read back: cuts lineage, survives lost executors.

    Each call takes a folder of its own, which the owner of the shared folder clears like any checkpoint, unless ``discard`` removes it before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``written`` that no plan reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
