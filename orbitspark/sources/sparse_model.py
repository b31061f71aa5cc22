"""Sparse reconstructions in the public binary layout: cameras.bin, images.bin, points3D.bin."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from orbitspark.errors import MissingOrForeign
from orbitspark.functions import linalg as la
from orbitspark.sources import streams

#: Parameters of each camera model by its number in the format.
MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8), 6: ("FULL_OPENCV", 12), 7: ("FOV", 5),
    8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12), 11: ("RAD_TAN_THIN_PRISM_FISHEYE", 16),
}
FILES = ("cameras.bin", "images.bin", "points3D.bin")


#: The layout of the files' records; names and lists of varying length follow them.
CAMERA = np.dtype([("camera_id", "<i4"), ("model", "<i4"), ("width", "<u8"), ("height", "<u8")])
IMAGE = np.dtype([("image_id", "<u4"), ("q", "<f8", 4), ("t", "<f8", 3), ("camera_id", "<u4")])
POINT = np.dtype([("point_id", "<u8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("rgb", "u1", 3), ("error", "<f8"), ("track_length", "<u8")])
OBSERVATION, TRACK = 24, 8
SCHEMAS = {
    "cameras.bin": "camera_id int, model string, width long, height long, params array<double>",
    "images.bin": "image_id long, name string, camera_id int, q array<double>, t array<double>, n_points2d long",
    "points3D.bin": "point_id long, x double, y double, z double, r int, g int, b int, error double, track_length long",
}


class Cut(Exception):
    """The block ends within a record."""


def number(block: memoryview, at: int) -> int:
    if at + 8 > len(block):
        raise Cut
    return int.from_bytes(block[at : at + 8], "little")


def camera_at(block: memoryview, at: int) -> tuple[int, tuple]:
    if at + CAMERA.itemsize > len(block):
        raise Cut
    name, n = MODELS[int.from_bytes(block[at + 4 : at + 8], "little", signed=True)]
    return at + CAMERA.itemsize + 8 * n, (name, n)


def image_at(block: memoryview, at: int) -> tuple[int, tuple]:
    start = at + IMAGE.itemsize
    end = block.obj.find(b"\0", start)
    if end < 0:
        raise Cut
    n = number(block, end + 1)
    return end + 9 + OBSERVATION * n, (bytes(block[start:end]).decode(), n)


def point_at(block: memoryview, at: int) -> tuple[int, tuple]:
    return at + POINT.itemsize + TRACK * number(block, at + POINT.itemsize - 8), ()


def lists(rows: np.ndarray) -> pa.Array:
    return pa.array(list(rows), pa.list_(pa.float64()))


def camera_columns(rows: np.ndarray, extra: list[tuple], block: bytes, at: np.ndarray) -> list:
    params = [np.frombuffer(block, "<f8", n, a + CAMERA.itemsize) for a, (_, n) in zip(at.tolist(), extra)]
    return [rows["camera_id"], [x[0] for x in extra], rows["width"].astype("i8"), rows["height"].astype("i8"), pa.array(params, pa.list_(pa.float64()))]


def image_columns(rows: np.ndarray, extra: list[tuple], block: bytes, at: np.ndarray) -> list:
    return [rows["image_id"].astype("i8"), [x[0] for x in extra], rows["camera_id"].astype("i4"), lists(rows["q"]), lists(rows["t"]), np.array([x[1] for x in extra], "i8")]


def point_columns(rows: np.ndarray, extra: list[tuple], block: bytes, at: np.ndarray) -> list:
    error = pa.array(rows["error"].astype("f8"), mask=rows["error"] < 0)
    return [rows["point_id"].astype("i8"), *(rows[c].astype("f8") for c in "xyz"), *(rows["rgb"][:, i].astype("i4") for i in range(3)), error, rows["track_length"].astype("i8")]


KINDS = {"cameras.bin": (CAMERA, camera_at, camera_columns), "images.bin": (IMAGE, image_at, image_columns), "points3D.bin": (POINT, point_at, point_columns)}


def parse(f, name: str, block_bytes: int = streams.BLOCK) -> Iterator[list]:
    """Columns of the records of an open file, a block at a time; ValueError if it is cut short.

    The ends of records depend on each other, so a file is one task's, but it holds no more than a block, or one longer record.
    """
    kind, record_at, columns = KINDS[name]
    head = f.read(8)
    if len(head) < 8:
        raise ValueError("cut short")
    left, block, more = int.from_bytes(head, "little"), b"", True
    if not left:
        yield columns(np.zeros(0, kind), [], b"", np.zeros(0, np.int64))
    while left:
        data = f.read(block_bytes)
        more, block, at, starts, extra = len(data) > 0, block + data, 0, [], []
        view = memoryview(block)
        try:
            while len(starts) < left:
                end, found = record_at(view, at)
                if end > len(block):
                    break
                starts.append(at)
                extra.append(found)
                at = end
        except Cut:
            pass
        if not starts and not more:
            raise ValueError("cut short")
        if starts:
            places = np.array(starts)
            fixed = np.frombuffer(block, "u1")[places[:, None] + np.arange(kind.itemsize)]
            yield columns(np.ascontiguousarray(fixed).view(kind)[:, 0], extra, block, places)
        left, block = left - len(starts), block[at:]


def to_batch(columns: list, name: str, folder: str) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    n = len(arrays[0])
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [x.split() for x in SCHEMAS[name].split(", ")]
    return pa.RecordBatch.from_arrays([a.cast(kinds[t]) for a, (_, t) in zip(arrays, fields)] + [pa.array([folder] * n, pa.string())], names=[c for c, _ in fields] + ["folder"])


def batches_of(f, name: str, folder: str) -> Iterator[pa.RecordBatch]:
    try:
        for columns in parse(f, name):
            yield to_batch(columns, name, folder)
    except (struct.error, ValueError, KeyError) as e:
        raise MissingOrForeign(f"{folder}/{name} can't be read: {e}") from e


class ModelReader(streams.RangeReader):
    splittable = False

    def __init__(self, options: dict):
        super().__init__(options)
        self.pattern = re.compile(f"^{re.escape(self.options['file'])}$")

    def batches(self, f, split: streams.Split) -> Iterator[pa.RecordBatch]:
        yield from batches_of(f, self.options["file"], split.uri.rsplit("/", 1)[0])


class ModelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orbitspark_sparse_model"

    def schema(self) -> str:
        return f"{SCHEMAS[self.options['file']]}, folder string"

    def reader(self, schema) -> ModelReader:
        return ModelReader(self.options)


def read_part(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the three files under a path, with the folder it lies in; a broken file is refused by the task that reads it."""
    if streams.readable(streams.qualified(spark, path)):
        return streams.load(spark, ModelSource, path, file=name)

    def run(batches):
        for batch in batches:
            for folder, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from batches_of(io.BytesIO(data.as_py()), name, folder)

    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "content").mapInArrow(run, f"{SCHEMAS[name]}, folder string")


def frame_id(name: Column) -> Column:
    """File name without folders and its last suffix."""
    return F.regexp_extract(name, r"([^/]+?)(\.[^./]*)?$", 1)


def intrinsics(model: Column, params: Column) -> dict[str, Column]:
    """fx, fy, cx, cy of models with one or two focal lengths; null for any other, never made up."""
    one = model.isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE")
    two = model.isin("PINHOLE", "OPENCV", "OPENCV_FISHEYE", "FULL_OPENCV", "FOV", "THIN_PRISM_FISHEYE", "RAD_TAN_THIN_PRISM_FISHEYE")
    at = lambda i, j: F.when(one, F.get(params, F.lit(i))).when(two, F.get(params, F.lit(j)))
    return {"fx": at(0, 0), "fy": at(0, 1), "cx": at(1, 2), "cy": at(2, 3)}


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Registered poses: folder, frame_id, size, intrinsics, r00..r22, t0..t2."""
    images, cameras = read_part(spark, path, "images.bin"), read_part(spark, path, "cameras.bin")
    both = images.join(cameras, ["folder", "camera_id"])
    m = la.quaternion_to_matrix(*(F.get("q", F.lit(i)) for i in range(4)))
    return both.select(
        "folder", frame_id(F.col("name")).alias("frame_id"), "width", "height", *(c.alias(n) for n, c in intrinsics(F.col("model"), F.col("params")).items()),
        *(m[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(F.get("t", F.lit(i)).alias(f"t{i}") for i in range(3)),
    )


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return read_part(spark, path, "points3D.bin")
