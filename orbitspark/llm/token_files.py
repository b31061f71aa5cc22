"""Token-id files in Simple-8b words, written and read on the executors.

A file holds, little-endian: the magic ``OS8B``, the version, the words, the words per block
(uint16), the document table (int64 id, a null mark, uint32 tokens), and a footer with the counts.
Files are numbered in ascending order of document id; a file is closed at ``max_ids`` ids, so that a
reader never holds more than that. Writers name files after their partition, write to a name of the
attempt and rename at the end: a task that runs again replaces its own file with the same bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitspark.llm import simple8b
from orbitspark.llm.common import new_path, stash, whole_text
from orbitspark.llm.vocab import encoder, slices

MAGIC, VERSION = b"OS8B", 1
HEAD = struct.Struct("<4sI")
FOOT = struct.Struct("<QQQQ4s")  # ids, words, blocks, documents


class FileWriter:
    """One file at a time, closed at ``max_ids`` ids; whole blocks go out as they fill."""

    def __init__(self, folder: str, part: int, attempt: int, max_ids: int):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.part, self.attempt, self.max_ids, self.number, self.out = part, attempt, max_ids, 0, None
        self.done: list[tuple[str, int, int]] = []

    def _open(self) -> None:
        self.name = f"part-{self.part:06d}-{self.number:04d}.s8b"
        self.temporary = f"{self.folder}/_{self.name}.{self.attempt}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(HEAD.pack(MAGIC, VERSION))
        self.rest, self.ids, self.words = np.zeros(0, np.uint64), 0, 0
        self.blocks, self.docs, self.nulls, self.sizes = [], [], [], []

    def _put(self, ids: np.ndarray) -> None:
        words, per_block = simple8b.encode(ids)
        self.out.write(words.astype("<u8").tobytes())
        self.blocks.append(per_block.astype("<u2"))
        self.words += len(words)

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        if self.out is None:
            self._open()
        self.docs.append(np.array([d or 0 for d in doc_ids], "<i8"))
        self.nulls.append(np.array([d is None for d in doc_ids], "u1"))
        self.sizes.append(counts.astype("<u4"))
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) // simple8b.BLOCK * simple8b.BLOCK
        self._put(ids[:whole])
        self.rest = ids[whole:]
        if self.ids >= self.max_ids:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self._put(self.rest)
        blocks = np.concatenate(self.blocks)
        docs = np.concatenate(self.docs)
        for table in (blocks, docs, np.concatenate(self.nulls), np.concatenate(self.sizes)):
            self.out.write(table.tobytes())
        self.out.write(FOOT.pack(self.ids, self.words, len(blocks), len(docs), MAGIC))
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        self.done.append((self.name, self.ids, len(docs)))
        self.number, self.out = self.number + 1, None


def parse_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their token counts and all ids of one file; ValueError if it is not whole."""
    try:
        magic, version = HEAD.unpack_from(content)
        n, words, blocks, docs, end = FOOT.unpack(content[-FOOT.size :])
    except struct.error as e:
        raise ValueError("not a token-id file") from e
    if magic != MAGIC or end != MAGIC or version != VERSION or len(content) != HEAD.size + 8 * words + 2 * blocks + 13 * docs + FOOT.size:
        raise ValueError("not a whole token-id file")
    at, out = HEAD.size, []
    for kind, count in (("<u8", words), ("<u2", blocks), ("<i8", docs), ("u1", docs), ("<u4", docs)):
        out.append(np.frombuffer(content, kind, count, at))
        at += out[-1].nbytes
    w, per_block, ids, null, sizes = out
    values = simple8b.decode(w.astype(np.uint64), per_block.astype(np.int64), n)
    return [None if x else int(i) for i, x in zip(ids, null)], sizes.astype(np.int64), values


def write_token_files(docs: DataFrame, folder: str, name: str = "byte_bpe_50k.json", end_id: int = 0, max_ids: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all whole texts, append ``end_id`` to each, write files into ``folder``; returns file, n_ids, n_docs.

    ``folder`` is a URI of a file system that pyarrow knows (file, hdfs, s3, gs); the reader takes any that Spark knows. Ids are whole numbers.

    Null text counts as empty (the end id alone). Documents go in ascending id, a null id first; rows
    of equal ids in the order of their text's hash. An empty table writes no file.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        writer, enc = FileWriter(folder, task.partitionId(), task.taskAttemptId(), max_ids), encoder(name)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                ids, counts = enc.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                writer.add(doc_ids[a:b], counts + 1, ids)
        writer.close()
        names, n, k = zip(*writer.done) if writer.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=["file", "n_ids", "n_docs"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    return stash(ordered.mapInArrow(run, "file string, n_ids long, n_docs long"), "manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start, n_tokens, ids_crc32, file, and ``ids`` on demand."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, sizes, ids = parse_file(content.as_py())
                ids, ends = ids.astype("<u4"), np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes, ends)]
                lists = [ids[e - s : e].astype(np.int64).tolist() for s, e in zip(sizes, ends)] if with_ids else [None] * len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rsplit("/", 1)[-1]] * len(sizes)), pa.array(doc_ids, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["file", "id", "local", "n_tokens", "ids_crc32", "ids"],
                )

    # Files are numbered within their writer's partition; only the sums of those are ordered in one task, a row a partition.
    parts = manifest.withColumn("part", F.substring_index("file", "-", 2))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    firsts = parts.join(bases, "part").select("file", (F.col("base") + before(Window.partitionBy("part").orderBy("file"))).alias("first"))
    if manifest.isEmpty():
        files = spark.createDataFrame([], "path string, content binary")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").load(folder).select("path", "content")
    schema = "file string, id long, local long, n_tokens long, ids_crc32 long, ids array<long>"
    out = files.mapInArrow(run, schema).join(firsts, "file")
    return out.select(F.col("id").alias(id_col), (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write all documents to token-id files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    manifest = write_token_files(docs, folder, name, end_id)
    return read_token_files(spark, folder, manifest)
