"""Packing by power-of-two decomposition.

A document of n tokens is cut into as many full pieces of ``max_len`` as fit and then one piece
for each binary digit of the rest, largest first. Every piece is a sequence of its own, so no
sequence crosses documents, none is padded, and sequences of equal length share a bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.llm.common import stash, whole_text
from orbitspark.llm.vocab import encoder, slices, trim

#: Bytes of text that a task encodes at once, and of an Arrow batch.
SLICE, BATCH = 3_000_000, 12_000_000


def binary_lengths(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of n tokens: full pieces, then falling powers of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 2, max_len: int = 4096, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` on demand.

    ``sequence_id`` numbers all sequences from 0, longest bucket first. Null text counts as empty:
    such a document is its end id alone. Repeated rows are packed again; an empty table gives none;
    other columns of ``docs`` are ignored. ``max_len`` must be a power of two.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        enc = encoder(name)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, SLICE):
                ids, counts = enc.encode(texts[a:b])
                ids, at, rows = ids.astype("<u4"), 0, []
                for i, n in enumerate(counts):
                    doc = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    start = 0
                    for length in binary_lengths(int(n) + 1, max_len):
                        piece = doc[start : start + length]
                        k = seen[length] = seen.get(length, -1) + 1
                        rows.append((a + i, start, length, zlib.crc32(piece), int(n) + 1, k, piece.tolist() if with_ids else None))
                        start += length
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0])), *(pa.array(c, t) for c, t in zip(cols[1:], kinds)), pa.array([part] * len(rows), pa.int32())],
                    names=["id", "start", "length", "ids_crc32", "doc_tokens", "k", "ids", "part"],
                )
        trim()

    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, k long, ids array<long>, part int"
    )
    pieces = stash(pieces, "pieces", BATCH)
    # One row a length and partition of the input: the first sequence number of each. Lengths, thirteen at most, are summed apart.
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.groupBy("length").agg(F.sum("n").alias("n")).select(F.col("length").alias("of"), F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("base"))
    firsts = counts.join(F.broadcast(bases), F.col("length") == F.col("of")).select("length", "part", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"))
    out = pieces.join(firsts, ["length", "part"])
    return out.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else [])
    )
