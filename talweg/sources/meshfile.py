"""Mesh files (OBJ, OFF, PLY, STL) as tables, and a data source ``format("mesh")``."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from talweg.functions.session import ship, written
from talweg.sources.tubes import Mesh


def fan(corners: list[int]) -> list[tuple[int, int, int]]:
    """Triangles of a polygon from its first corner."""
    return [(corners[0], corners[i], corners[i + 1]) for i in range(1, len(corners) - 1)]


def read_obj(data: bytes) -> tuple[list, list]:
    v, f = [], []
    for line in data.decode("utf-8", "replace").replace("\\\n", " ").splitlines():
        p = line.split()
        if p[:1] == ["v"]:
            v.append(tuple(map(float, p[1:4])))
        elif p[:1] == ["f"]:
            ids = [int(x.split("/")[0]) for x in p[1:]]
            f += fan([i - 1 if i > 0 else len(v) + i for i in ids])
    return v, f


def read_off(data: bytes) -> tuple[list, list]:
    rows = [line.split("#")[0].split() for line in data.decode("utf-8", "replace").splitlines()]
    rows = [r for r in rows if r]
    if rows and rows[0][0].upper().endswith("OFF"):
        rows = ([rows[0][1:]] if len(rows[0]) > 1 else []) + rows[1:]
    nv, nf = int(rows[0][0]), int(rows[0][1])
    v = [tuple(map(float, r[:3])) for r in rows[1 : 1 + nv]]
    return v, [t for r in rows[1 + nv : 1 + nv + nf] for t in fan(list(map(int, r[1 : 1 + int(r[0])])))]


#: The scalar types of PLY headers as struct codes.
PLY_TYPES = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}


def read_ply(data: bytes) -> tuple[list, list]:
    head, body = re.match(rb"(.*?end_header\s*?\n)(.*)", data, re.S).groups()
    kind, elements = "ascii", []
    for p in map(str.split, head.decode("ascii", "replace").splitlines()):
        if p[:1] == ["format"]:
            kind = p[1]
        elif p[:1] == ["element"]:
            elements.append((p[1], int(p[2]), []))
        elif p[:1] == ["property"]:
            elements[-1][2].append(p[1:])
    words, at, order = iter(body.split()) if kind == "ascii" else None, 0, "<" if "little" in kind else ">"

    def take(code: str) -> float:
        nonlocal at
        if words is not None:
            return float(next(words))
        got = struct.unpack_from(order + code, body, at)[0]
        at += struct.calcsize(code)
        return got

    v, f = [], []
    for name, n, props in elements:
        for _ in range(n):
            row = {}
            for p in props:
                row[p[-1]] = [take(PLY_TYPES[p[2]]) for _ in range(int(take(PLY_TYPES[p[1]])))] if p[0] == "list" else take(PLY_TYPES[p[0]])
            if name == "vertex":
                v.append((row["x"], row["y"], row["z"]))
            elif name == "face":
                f += fan([int(i) for i in next(x for x in row.values() if isinstance(x, list))])
    return v, f


def read_stl(data: bytes) -> tuple[list, list]:
    """Triangles hold their own corners; equal corners become one vertex, in order of first use."""
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]:
        rows = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]), offset=84)["p"].astype(float).reshape(-1, 3)
    else:
        rows = np.array([list(map(float, m.split())) for m in re.findall(r"vertex\s+(\S+\s+\S+\s+\S+)", data.decode("utf-8", "replace"))]).reshape(-1, 3)
    at: dict[tuple, int] = {}
    ids = [at.setdefault(p, len(at)) for p in map(tuple, rows.tolist())]
    return list(at), [tuple(ids[i : i + 3]) for i in range(0, len(ids), 3)]


READERS = {"obj": read_obj, "off": read_off, "ply": read_ply, "stl": read_stl}


def parse(path: str, data: bytes) -> tuple[list, list]:
    kind = path.rpartition(".")[2].lower()
    if kind not in READERS:
        raise ValueError(f"{path}: not one of {', '.join(READERS)}")
    v, f = READERS[kind](data)
    if not v or not f:
        raise TypeError(f"{path}: no single triangle mesh")
    return v, f


def _rows(batches):
    """Vertices and faces of each file, read once: place, and what a vertex or a face has."""
    for pdf in batches:
        for mesh_id, path, data in zip(pdf["mesh_id"], pdf["path"], pdf["content"], strict=True):
            v, f = parse(path, bytes(data))
            for face, rows, cols in ((False, v, ["x", "y", "z"]), (True, f, ["a", "b", "c"])):
                out = pd.DataFrame(rows, columns=cols).rename_axis("place").reset_index().assign(mesh_id=mesh_id, face=face)
                yield out.reindex(columns=["mesh_id", "face", "place", "x", "y", "z", "a", "b", "c"]).astype({c: "Int64" for c in "abc"})


def mesh_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``mesh_id, path`` of the files that ``load_meshes`` reads, numbered by order of path. Only paths are sorted."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.select((F.row_number().over(Window.orderBy("path")) - 1).alias("mesh_id"), "path")


def load_meshes(spark: SparkSession, path: str | list[str]) -> Mesh:
    """All mesh files of paths or a glob, one mesh each, numbered by order of path; vertex order is kept.

    Files come through Spark's reader, so any store works. Each is parsed once, into a written table of both parts.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.join(mesh_names(spark, path), "path").select("mesh_id", "path", "content")
    rows = written(files.mapInPandas(_rows, "mesh_id int, face boolean, place int, x double, y double, z double, a int, b int, c int"), "meshes")
    return Mesh(rows.where("not face").select("mesh_id", F.col("place").alias("vid"), "x", "y", "z"), rows.where("face").select("mesh_id", F.col("place").alias("fid"), "a", "b", "c"))


class MeshSource(DataSource):
    """``spark.read.format("mesh").option("part", "vertices" or "faces").load(file)`` after ``spark.dataSource.register(MeshSource)``."""

    @classmethod
    def name(cls) -> str:
        return "mesh"

    def schema(self) -> str:
        return "fid int, a int, b int, c int" if self.options.get("part", "vertices") == "faces" else "vid int, x double, y double, z double"

    def reader(self, schema) -> MeshReader:
        return MeshReader(self.options)


class MeshReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.faces = options["path"], options.get("part", "vertices") == "faces"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition):
        store, path = FileSystem.from_uri(partition.value)  # a path or the address of any store that Arrow knows
        with store.open_input_stream(path) as f:
            rows = parse(partition.value, f.read())[self.faces]
        yield from ((i, *r) for i, r in enumerate(rows))


def with_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` of the files that ``load_meshes`` would read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
