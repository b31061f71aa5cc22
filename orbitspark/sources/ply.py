"""Binary PLY point clouds: float32 coordinates and byte colours, little-endian."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from orbitspark.errors import AlreadyThere, MissingOrForeign
from orbitspark.sources import streams

ROW = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
FIELDS = (("float", "x"), ("float", "y"), ("float", "z"), ("uchar", "red"), ("uchar", "green"), ("uchar", "blue"))

#: Points that a task holds at once: 30 MB.
POINTS_A_FILE = 2_000_000


def parts_for(n_points: int) -> int:
    """Files so that each holds about ``POINTS_A_FILE`` points."""
    return max(1, -(-n_points // POINTS_A_FILE))


def header(count: int, comments: dict[str, str]) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", *(f"comment {k}: {v}" for k, v in comments.items()), f"element vertex {count}", *(f"property {t} {n}" for t, n in FIELDS), "end_header", ""]
    return "\n".join(lines).encode("ascii")


MARK = b"end_header\n"
MOST_HEADER = 1 << 20


def parse_header(head: bytes) -> tuple[dict[str, str], int, int]:
    """Comments, number of points, and where their bytes start; MissingOrForeign for another layout."""
    end = head.find(MARK)
    if not head.startswith(b"ply\n") or end < 0:
        raise MissingOrForeign("not a PLY file")
    comments, count, fields = {}, None, []
    for line in head[:end].decode("ascii", "replace").split("\n")[1:]:
        kind, _, rest = line.partition(" ")
        if kind == "comment":
            key, _, value = rest.partition(": ")
            comments[key] = value
        elif kind == "element" and rest.startswith("vertex "):
            count = int(rest.split()[1])
        elif kind == "property":
            fields.append(tuple(rest.split()))
        elif kind == "format" and not rest.startswith("binary_little_endian"):
            raise MissingOrForeign("not a little-endian binary PLY file")
    if count is None or tuple(fields) != FIELDS:
        raise MissingOrForeign("the PLY file has another layout")
    return comments, count, end + len(MARK)


def check_length(size: int, start: int, count: int) -> None:
    if size != start + count * ROW.itemsize:
        raise MissingOrForeign("the PLY file has another length than its header says")


def parse(content: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Comments and rows of a whole file; MissingOrForeign for another layout or a payload of the wrong length."""
    comments, count, start = parse_header(content)
    check_length(len(content), start, count)
    return comments, np.frombuffer(content, ROW, count, start)


SCHEMA = "file string, run_id string, point_id long, x double, y double, z double, r int, g int, b int"


def batch_of(file: str, comments: dict[str, str], first: int, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of a file from row ``first`` on."""
    n, base = len(rows), int(comments.get("first_point_id", 0)) + first
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * n, pa.string()), pa.array([comments.get("run_id")] * n, pa.string()), pa.array(np.arange(base, base + n)), *(pa.array(rows[c].astype("f8")) for c in "xyz"), *(pa.array(rows[c].astype("i4")) for c in "rgb")],
        names=["file", "run_id", "point_id", *"xyzrgb"],
    )


class PlyReader(streams.RangeReader):
    """Splits hold the rows that start in their bytes; each looks at the header and the file's length for itself."""

    pattern = re.compile(r"\.ply$")

    def batches(self, f, split: streams.Split) -> Iterator[pa.RecordBatch]:
        head = f.read(4096)
        while MARK not in head and len(head) < min(split.size, MOST_HEADER):
            head += f.read(len(head))
        comments, count, start = parse_header(head)
        check_length(split.size, start, count)
        row_at = lambda byte: min(count, max(0, -(-(byte - start) // ROW.itemsize)))
        at, end = row_at(split.start), row_at(split.end)
        f.seek(start + at * ROW.itemsize)
        while at < end:
            n = min(end - at, streams.BLOCK // ROW.itemsize)
            data = f.read(n * ROW.itemsize)
            yield batch_of(split.uri, comments, at, np.frombuffer(data, ROW, n))
            at += n


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orbitspark_ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options)


def read_ply(spark: SparkSession, path: str, split: int = streams.SPLIT) -> DataFrame:
    """Points of all PLY files under a path: file, run_id (of the header), point_id (row), x, y, z, r, g, b.

    A file is read in splits of ``split`` bytes by as many tasks, whatever its length; where only Spark can open it, whole.
    """
    if streams.readable(streams.qualified(spark, path)):
        return streams.load(spark, PlySource, path, split=split)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                comments, rows = parse(content.as_py())
                for a in range(0, len(rows), 1_000_000):
                    yield batch_of(name, comments, a, rows[a : a + 1_000_000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def write_ply(points: DataFrame, folder: str, run_id: str, comments: dict[str, str] | None = None, parts: int = 1) -> DataFrame:
    """Writes the points in order of ``point_id`` as ``parts`` PLY files; returns file and count.

    Non-finite points can't be shown and are left out. A writer that runs again replaces its own file.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    if any(i.extension == "ply" for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True))):
        raise AlreadyThere(f"there are PLY files in {folder}")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        rows = [np.zeros(0, ROW)]
        for batch in batches:
            part = np.zeros(batch.num_rows, ROW)
            for c in ROW.names:
                part[c] = batch.column(batch.schema.get_field_index(c)).to_numpy()
            rows.append(part)
        data = np.concatenate(rows)
        if len(data) or task.partitionId() == 0:
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            name = f"points-{task.partitionId():05d}.ply"
            with store.open_output_stream(f"{base}/_{name}.{task.taskAttemptId()}") as out:
                out.write(header(len(data), {"run_id": run_id} | (comments or {})) + data.tobytes())
            store.move(f"{base}/_{name}.{task.taskAttemptId()}", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], names=["file", "n_points"])

    from orbitspark.operators.cloud import is_valid_point

    valid = points.where(is_valid_point()).repartitionByRange(parts, "point_id").sortWithinPartitions("point_id").select(*ROW.names)
    done = valid.mapInArrow(run, "file string, n_points long").collect()
    return points.sparkSession.createDataFrame(done or [], "file string, n_points long")
