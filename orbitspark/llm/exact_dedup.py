"""Exact deduplication by a stateful stream, with DataFrame operations only.

Rows are written once with a row number and the SHA-256 of their normalised text. A stream over that
table keeps, in RocksDB on disk and without expiry, one entry a digest: the smallest id with the row
number that locates its content, and the number of rows. Later arrivals go to the same table and state. The entries are then read from the state
itself. Digests seen more than once are hits: the full bytes of each such row are compared with the
located row, and rows that differ under one digest are parted by their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitspark.llm.common import MOST_BROADCAST, Scratch, drop_folder, exists, fits, hinted, join_groups, new_path, whole_text

STORE = "spark.sql.streaming.stateStore"
#: State on disk, a bound on what all its stores of an executor hold in memory, and no store left open behind its task.
ROCKSDB = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{STORE}.rocksdb.boundedMemoryUsage": "true", f"{STORE}.rocksdb.maxMemoryUsageMB": "96",
    f"{STORE}.rocksdb.writeBufferSizeMB": "4", f"{STORE}.rocksdb.maxWriteBufferNumber": "2", f"{STORE}.unloadOnCommit": "true",
}


def normalised(text: str | Column = "text") -> Column:
    """White space runs as one space; null counts as empty."""
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", " ")


def first_seen(spark: SparkSession, arrivals: str, state: str, files_per_batch: int = 256) -> DataFrame:
    """One row a digest of a table of arrivals (digest, id, rid): first (id, rid) and copies.

    The stream's state lives in RocksDB with checkpoints in ``state``; a lost executor's part is restored from
    there. Files of ``arrivals`` that the state has taken in are not read again. The stream has a session of its
    own, so that its settings touch no other query.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for k, v in ROCKSDB.items():
        own.conf.set(k, v)
    schema = spark.read.parquet(arrivals).schema
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
    seen = stream.groupBy("digest").agg(F.min(F.struct("id", "rid")).alias("first"), F.count("*").alias("copies"))
    seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    entries = spark.read.format("statestore").load(state)
    first, copies = entries.schema["value"].dataType.fieldNames()
    return entries.select(F.col("key.digest").alias("digest"), F.col("value")[first].alias("first"), F.col("value")[copies].alias("copies"))


def exact_duplicates(
    docs: DataFrame, digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256), id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False, store: str | None = None, most_bytes: int = MOST_BROADCAST
) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256, and with ``keep_rows`` the whole row as ``row``.

    Texts are equal if they are after each run of white space is one space; null counts as empty. The
    row of the smallest id stays (a null id is smallest); of rows that share that id, the one that came first. Each
    repeated row counts. Ids are whole numbers. An empty table gives an empty table. All columns of ``docs`` may
    have any name; they travel inside ``row``.

    ``store`` names a folder that keeps arrivals and state: calls with the same one add ``docs`` (of the same columns) to what came
    before, the state takes in the new rows only, and the result is that of all arrivals. A row is located by its number,
    unique over all of them. Tables of hits are broadcast up to ``most_bytes``; beyond, hot digests are, and the others are shuffled.
    """
    spark = docs.sparkSession
    scratch, folder = Scratch(spark), store or new_path(spark, "dedup")
    arrivals, state = f"{folder}/arrivals", f"{folder}/state"
    text = normalised(F.col("row")[text_col])
    rows = docs.select((F.struct("*") if keep_rows else F.struct(id_col, text_col)).alias("row"))
    rows = rows.select("row", F.col("row")[id_col].cast("long").alias("id"), F.sha2(text, 256).alias("sha"), digest(text).alias("digest"))
    before = spark.read.parquet(arrivals).agg(F.max("rid")).first()[0] if exists(spark, arrivals) else None
    rows = rows.withColumn("rid", F.monotonically_increasing_id() + F.lit(0 if before is None else before + 1))
    rows.write.mode("append").parquet(arrivals)
    rows = spark.read.schema(rows.schema).parquet(arrivals)
    total = rows.count()
    if not total:
        entries = spark.createDataFrame([], "digest string, first struct<id:long,rid:long>, copies long")
    else:
        entries = scratch.stash(first_seen(spark, arrivals, state), "entries")
    hits = entries.where("copies > 1").select("digest", F.col("first.rid").alias("first"), "copies")
    few = fits(hits, most_bytes)

    def with_hits(table: DataFrame) -> DataFrame:
        return table.join(F.broadcast(hits), "digest") if few else join_groups(table, hits, "digest", "copies", total, inner=True)

    # The located row once for every few hundred of its hits, so that no hot group meets in one task.
    salts = F.ceil(F.col("copies") / 500).cast("int")
    located = rows.join(hinted(hits.select(F.col("first").alias("rid"), "copies"), most_bytes), "rid")
    located = located.select("digest", text.alias("located"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    texts = with_hits(rows).select("rid", "id", "digest", "first", text.alias("text"), F.pmod(F.xxhash64("rid"), salts.cast("long")).cast("int").alias("salt"))
    same = scratch.stash(texts.join(located, ["digest", "salt"]).select("rid", "digest", (F.col("text") == F.col("located")).alias("same")), "compared")

    groups = with_hits(rows.select("rid", "digest")).select("rid", "digest", F.col("first").alias("keep_rid"), "copies")
    collided = same.where("not same").select("digest").distinct()
    if not collided.isEmpty():
        members = texts.join(collided, "digest").select("rid", "id", F.struct("digest", "text").alias("own"))
        parted = members.groupBy("own").agg(F.min(F.struct("id", "rid")).alias("first"), F.count("*").alias("copies"))
        fixed = join_groups(members, parted, "own", "copies", total, inner=True).select("rid", F.col("own.digest").alias("digest"), F.col("first.rid").alias("keep_rid"), "copies")
        groups = groups.join(collided, "digest", "left_anti").unionByName(fixed)
    groups = scratch.stash(groups.drop("digest"), "groups")
    firsts = rows.select(F.col("rid").alias("keep_rid"), F.col("id").alias("keep_id"))
    many = groups.groupBy("keep_rid").agg(F.count("*").alias("n")).join(firsts, "keep_rid")
    known = scratch.stash(join_groups(groups, many, "keep_rid", "n", total).select("rid", "keep_rid", "keep_id", F.col("copies").alias("group_size"), F.lit(True).alias("grouped")), "known")
    scratch.drop(but=[known])
    if store is None and exists(spark, state):
        drop_folder(spark, state)
    out = (rows if keep_rows else rows.select("rid", "id", "sha", "row")).join(known, "rid", "left")
    kept = F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(True))
    return out.select(
        F.col("row")[id_col].alias(id_col), F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"), F.col("sha").alias("text_sha256"), *(["row"] if keep_rows else []),
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    return exact_duplicates(docs, keep_rows=True, **options).where("kept").select("row.*")
