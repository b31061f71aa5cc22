"""Files read in pieces on the executors, by byte range, so that no task ever holds one.

File systems that pyarrow knows (file, hdfs, s3, gs, abfs) are read this way. What only Spark can open is
left to its own whole-file reader, which is bounded by 2 GB a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a split, and bytes that a reader holds at once.
SPLIT, BLOCK = 64 << 20, 8 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def file_system(uri: str):
    """File system and path of a URI as Spark writes it: characters stand as they are."""
    from pyarrow import fs

    local = re.match(r"^file:(?://(?=/))?(/.*)$", uri)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(quote(uri, safe=":/@?=&,;+~"))


def readable(uri: str) -> bool:
    """Whether pyarrow has a file system for the URI's scheme."""
    try:
        file_system(uri)
    except (pa.ArrowException, OSError, NotImplementedError):
        return False
    return True


def files_below(uri: str, name: re.Pattern) -> list[tuple[str, int]]:
    """(URI, bytes) of the file, or of all files below the folder, whose last name matches; as much metadata as Spark's own listing holds."""
    from pyarrow import fs

    store, path = file_system(uri)
    info = store.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else []
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else re.match(r"^\w+:(//[^/]*)?", uri)[0]
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and name.search(f.base_name))


@dataclass
class Split(InputPartition):
    """A byte range of a file; ``size`` is that of the whole file."""

    uri: str
    start: int
    end: int
    size: int


def splits_of(files: list[tuple[str, int]], split: int | None) -> list[Split]:
    """Ranges of ``split`` bytes, or whole files where None."""
    return [Split(uri, a, min(a + (split or max(1, size)), size), size) for uri, size in files for a in range(0, max(1, size), split or max(1, size))]


class RangeReader(DataSourceReader):
    """Reads files of one kind; a subclass names them and yields the record batches of a split."""

    pattern: re.Pattern
    splittable = True

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Split]:
        files = files_below(self.options["path"], self.pattern)
        return splits_of(files, int(self.options.get("split", SPLIT)) if self.splittable else None) or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.uri:
            store, path = file_system(partition.uri)
            with store.open_input_file(path) as f:
                yield from self.batches(f, partition)

    def batches(self, f, split: Split) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def load(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(qualified(spark, path))
