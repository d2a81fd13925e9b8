"""Deterministic meshes from the ``part`` table: every 200 parts are one open square tube."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.session import ship

#: Cells (i, j) that are left out, by name of the variant.
HOLES = {"plain": "false", "windows": "j in (4, 5) and i in (3, 13)", "isolated": "j in (4, 5) and i in (3, 4, 13, 14)"}


@dataclass
class Mesh:
    """Many triangle meshes: ``vertices(mesh_id, vid, x, y, z)`` and ``faces(mesh_id, fid, a, b, c)``."""

    vertices: DataFrame
    faces: DataFrame


def tubes(spark: SparkSession, sf_dir: str, variant: str = "windows", amp: float = 0.3) -> Mesh:
    """Tubes of 20 x 10 vertices; ``amp`` roughens the height of the inner rows."""
    ship(spark)
    key, i = F.col("p_partkey"), F.col("p_partkey") % 20
    j = F.floor((F.col("p_partkey") % 200) / 20)
    bump = F.when(j.isin(0, 9), 0).otherwise((F.col("p_size") * 7 + key * 3) % 11)
    vertices = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.floor(key / 200).cast("int").alias("mesh_id"),
        (key % 200).cast("int").alias("vid"),
        F.when(i < 5, i).when(i < 10, 5).when(i < 15, 15 - i).otherwise(0).cast("double").alias("x"),
        F.when(i < 5, 0).when(i < 10, i - 5).when(i < 15, 5).otherwise(20 - i).cast("double").alias("y"),
        (j.cast("double") + F.lit(float(amp)) * bump).alias("z"),
    )
    meshes = vertices.where("vid = 0").select("mesh_id")
    cells = meshes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(179)))).selectExpr("mesh_id", "cell", "cell % 20 as i", "cell div 20 as j").where(f"not ({HOLES[variant]})")
    faces = cells.selectExpr(
        "mesh_id",
        """inline(array(
          named_struct('fid', 2 * int(cell), 'a', int(20 * j + i), 'b', int(20 * j + (i + 1) % 20), 'c', int(20 * (j + 1) + i)),
          named_struct('fid', 2 * int(cell) + 1, 'a', int(20 * j + (i + 1) % 20), 'b', int(20 * (j + 1) + (i + 1) % 20), 'c', int(20 * (j + 1) + i))))""",
    )
    return Mesh(vertices, faces)
