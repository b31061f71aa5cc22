"""Writes sparse reconstructions in the public binary layout: records are made by many tasks, and each file is one.

A task writes its records, in order, to a part of its own attempt; which parts count is what the tasks returned. One task then streams
header and parts into the file, a block at a time, under a name of its own, and renames it at the end.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.errors import AlreadyThere
from orbitspark.functions import linalg as la
from orbitspark.operators import cameras as cam
from orbitspark.sources import streams
from orbitspark.sources.sparse_model import CAMERA, IMAGE, POINT

#: The number of the model with two focal lengths, and the layout of lists behind a record.
PINHOLE = 1
SEEN = np.dtype([("u", "<f8"), ("v", "<f8"), ("point_id", "<u8")])
TRACK = np.dtype([("image_id", "<u4"), ("place", "<u4")])


def interleaved(fixed: np.ndarray, lists: np.ndarray, lens: np.ndarray) -> bytes:
    """Each fixed record followed by its list's records, of which it has ``lens``."""
    size, each = fixed.dtype.itemsize, lists.dtype.itemsize
    sizes = size + lens * each
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), "u1")
    if len(fixed):
        out[starts[:, None] + np.arange(size)] = np.frombuffer(fixed.tobytes(), "u1").reshape(len(fixed), size)
    if len(lists):
        begin = np.repeat(starts + size, lens) + (np.arange(len(lists)) - np.repeat(np.cumsum(lens) - lens, lens)) * each
        out[begin[:, None] + np.arange(each)] = np.frombuffer(lists.tobytes(), "u1").reshape(len(lists), each)
    return out.tobytes()


def record_list(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """A list column of structs as records, and how many each row has."""
    flat, lens = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(flat), kind)
    for c in kind.names:
        out[c] = flat.field(c).to_numpy(zero_copy_only=False)
    return out, lens


def camera_records(batch: pa.RecordBatch) -> bytes:
    fixed = np.zeros(batch.num_rows, np.dtype([*CAMERA.descr, ("params", "<f8", 4)]))
    for c in ("camera_id", "width", "height"):
        fixed[c] = batch[c].to_numpy(zero_copy_only=False)
    fixed["model"] = PINHOLE
    fixed["params"] = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("fx", "fy", "cx", "cy")], axis=1)
    return fixed.tobytes()


def image_records(batch: pa.RecordBatch) -> bytes:
    fixed = np.zeros(batch.num_rows, IMAGE)
    fixed["image_id"], fixed["camera_id"] = (batch[c].to_numpy(zero_copy_only=False) for c in ("image_id", "camera_id"))
    for name, width in (("q", 4), ("t", 3)):
        fixed[name] = np.stack([batch[f"{name}{i}"].to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
    seen, lens = record_list(batch["seen"], SEEN)
    ends = np.cumsum(lens)
    names = batch["name"].to_pylist()
    return b"".join(fixed[i].tobytes() + names[i].encode() + b"\0" + struct.pack("<Q", lens[i]) + seen[ends[i] - lens[i] : ends[i]].tobytes() for i in range(batch.num_rows))


def point_records(batch: pa.RecordBatch) -> bytes:
    fixed = np.zeros(batch.num_rows, POINT)
    for c in ("point_id", *"xyz"):
        fixed[c] = batch[c].to_numpy(zero_copy_only=False)
    fixed["rgb"] = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in "rgb"], axis=1)
    fixed["error"] = batch["error"].fill_null(-1.0).to_numpy(zero_copy_only=False)
    tracks, lens = record_list(batch["track"], TRACK)
    fixed["track_length"] = lens
    return interleaved(fixed, tracks, lens)


def write_file(rows: DataFrame, order: str, encode: Callable[[pa.RecordBatch], bytes], folder: str, name: str, parts: int) -> int:
    """One file of all rows in ascending ``order``; returns how many. AlreadyThere if there is one."""
    spark = rows.sparkSession
    base = streams.qualified(spark, folder).rstrip("/")
    store, path = streams.file_system(base)
    if store.get_file_info(f"{path}/{name}").type.name != "NotFound":
        raise AlreadyThere(f"there is a {name} in {folder}")
    stem = f"_{name}-{uuid.uuid4().hex}"

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, path = streams.file_system(base)
        store.create_dir(path, recursive=True)
        part, n = f"{stem}.{task.partitionId()}.{task.taskAttemptId()}", 0
        with store.open_output_stream(f"{path}/{part}") as out:
            for batch in batches:
                out.write(encode(batch))
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([part]), pa.array([n], pa.int64())], names=["place", "part", "n"])

    done = rows.repartitionByRange(parts, order).sortWithinPartitions(order).mapInArrow(run, "place int, part string, n long")

    def join(batches):
        store, path = streams.file_system(base)
        found = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        total = sum(n for _, _, n in found)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{stem}") as out:
            out.write(struct.pack("<Q", total))
            for _, part, _ in found:
                with store.open_input_stream(f"{path}/{part}") as f:
                    while data := f.read(streams.BLOCK):
                        out.write(data)
        store.move(f"{path}/{stem}", f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    # The list of parts is a row a task; their bytes pass through one task in blocks, as one file has one writer.
    listed = spark.createDataFrame(done.collect(), done.schema)
    total = listed.coalesce(1).mapInArrow(join, "n long").first()[0]
    for info in store.get_file_info(streams_selector(path)):
        if info.base_name.startswith(stem):
            store.delete_file(info.path)
    return total


def streams_selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)


def observation_lists(seen: DataFrame, image: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """What each image sees, (u, v, point_id) in order of points, and each point's track of (image, place in that list)."""
    placed = seen.withColumn("place", F.row_number().over(Window.partitionBy(image).orderBy("point_id")) - 1)
    images = placed.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("place", "u", "v", "point_id"))).alias("s")).select(image, F.transform("s", lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"), x["point_id"].alias("point_id"))).alias("seen"))
    tracks = placed.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct(F.col(image).alias("image_id"), "place"))).alias("track"))
    return images, tracks


def write_model(cameras: DataFrame, points: DataFrame, seen: DataFrame, folder: str, parts: int = 1, name: Column | None = None) -> dict[str, int]:
    """Writes cameras.bin, images.bin and points3D.bin; returns the records of each.

    cameras: image_id (from 1), frame_id, a pose, fx, fy, cx, cy, width, height; points: point_id, x, y, z, r, g, b, error (null where there is
    none); seen: image_id, point_id, u, v. Every image has a camera of its own. Points without a track are written with an empty one.
    """
    images, tracks = observation_lists(seen)
    q = la.matrix_to_quaternion(cam.rotation())
    none = lambda like, c: F.coalesce(c, F.array().cast(like.schema[c].dataType))
    posed = cameras.select(F.col("image_id"), F.col("image_id").alias("camera_id"), (F.concat("frame_id", F.lit(".jpg")) if name is None else name).alias("name"), *(x.alias(f"q{i}") for i, x in enumerate(q)), *cam.T)
    posed = posed.join(images, "image_id", "left").withColumn("seen", none(images, "seen"))
    if "error" not in points.columns:
        points = points.withColumn("error", F.lit(None).cast("double"))
    cloud = points.select("point_id", *"xyz", *"rgb", "error").join(tracks, "point_id", "left").withColumn("track", none(tracks, "track"))
    lens = cameras.select(F.col("image_id").alias("camera_id"), "width", "height", "fx", "fy", "cx", "cy")
    return {
        "cameras.bin": write_file(lens, "camera_id", camera_records, folder, "cameras.bin", 1), "images.bin": write_file(posed, "image_id", image_records, folder, "images.bin", parts),
        "points3D.bin": write_file(cloud, "point_id", point_records, folder, "points3D.bin", parts),
    }
