"""File checksums: recorded lists and what lies in a folder."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orbitspark.errors import PackageBroken
from orbitspark.operators.runs import compare_manifests
from orbitspark.sources import streams

LINE = r"^([0-9a-fA-F]{64})  \*?(.+)$"


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Checksums and paths of a list; PackageBroken for a line that is neither blank nor of the format."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = lines.where(~F.col("value").rlike(LINE)).limit(1).collect()
    if bad:
        raise PackageBroken(f"not a checksum line: {bad[0][0][:80]}")
    return lines.select(F.regexp_extract("value", LINE, 2).alias("path"), F.lower(F.regexp_extract("value", LINE, 1)).alias("sha256"))


@dataclass
class Files(InputPartition):
    """Some files (URI, bytes)."""

    files: list[tuple[str, int]]


class ChecksumReader(DataSourceReader):
    """All files below a folder, dealt by bytes and number; each is read a block at a time, so files of any length pass through a task of any size."""

    def __init__(self, options: dict):
        self.uri, self.bytes, self.number = options["path"], int(options.get("bytes", streams.SPLIT)), int(options.get("number", 1000))

    def partitions(self) -> list[Files]:
        out, held = [[]], 0
        for uri, size in streams.files_below(self.uri, re.compile("")):
            if out[-1] and (held + size > self.bytes or len(out[-1]) >= self.number):
                out, held = [*out, []], 0
            out[-1].append((uri, size))
            held += size
        return [Files(x) for x in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        sums = []
        for uri, _ in partition.files:
            store, place = streams.file_system(uri)
            digest = sha256()
            with store.open_input_stream(place) as f:
                while data := f.read(streams.BLOCK):
                    digest.update(data)
            sums.append(digest.hexdigest())
        paths, sizes = zip(*partition.files) if partition.files else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], names=["path", "length", "sha256"])


class ChecksumSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orbitspark_checksums"

    def schema(self) -> str:
        return "path string, length long, sha256 string"

    def reader(self, schema) -> ChecksumReader:
        return ChecksumReader(self.options)


def list_folder(spark: SparkSession, folder: str, but: str = "SHA256SUMS") -> DataFrame:
    """Path within the folder, length and checksum of every file below it, empty ones too.

    Where only Spark can open the files it reads them whole, and leaves out empty ones.
    """
    base = streams.qualified(spark, folder).rstrip("/")
    if streams.readable(base):
        rows = streams.load(spark, ChecksumSource, folder)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        rows = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    plain = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    rows = rows.select(plain(F.col("path")).alias("p"), plain(F.lit(base)).alias("base"), "length", "sha256")
    return rows.select(F.expr("substring(p, length(base) + 2)").alias("path"), "length", "sha256").where(F.col("path") != but)


def lines(listing: DataFrame) -> DataFrame:
    """The list's text, sorted by path."""
    return listing.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def verify(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """What changed, is missing or is extra against the folder's own list."""
    return compare_manifests(read_list(spark, f"{folder}/SHA256SUMS"), list_folder(spark, folder), strict)
