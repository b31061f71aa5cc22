"""Shared pieces: tables, the shared work folder, and joins that stand hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For tables with rows of megabytes: readers hold a row group, several times over if it has arrays, and Parquet looks at its size after a hundred rows by default.
WIDE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the cluster names none, a local session gets a temporary folder of its own; any
    other master is refused, since executors could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="orbitspark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/orbitspark/{name}-{uuid.uuid4().hex}"


def stash_at(df: DataFrame, name: str, batch_bytes: int | None = None, options: dict | None = None) -> tuple[DataFrame, str]:
    """``stash``, and the folder of the table."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(BATCH_BYTES)
    if batch_bytes:
        spark.conf.set(BATCH_BYTES, batch_bytes)
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)
    return spark.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, name: str, batch_bytes: int | None = None, options: dict | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it: cuts lineage, survives lost executors.

    ``batch_bytes`` bounds the Arrow batches that the write hands to Python, one row at least; ``options`` are the writer's.
    """
    return stash_at(df, name, batch_bytes, options)[0]


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


class Scratch:
    """The written tables of one operator; those that its result doesn't read are deleted when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def stash(self, df: DataFrame, name: str, batch_bytes: int | None = None, options: dict | None = None) -> DataFrame:
        out, path = stash_at(df, name, batch_bytes, options)
        self.tables.append((out, path))
        return out

    def discard(self, df: DataFrame) -> None:
        for other, path in self.tables:
            if other is df:
                drop_folder(self.spark, path)
        self.tables = [(other, path) for other, path in self.tables if other is not df]

    def drop(self, but: list[DataFrame]) -> None:
        for df, path in self.tables:
            if not any(df is kept for kept in but):
                drop_folder(self.spark, path)
        self.tables = [(df, path) for df, path in self.tables if any(df is kept for kept in but)]


def whole_text(text: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def bucket_of_id(doc_id: str, buckets: int = 5) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % buckets


#: Rows up to which no group counts as hot.
LIGHT = 1000
#: Bytes up to which a table is broadcast.
MOST_BROADCAST = 32 << 20


def bytes_of(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes, whole strings and arrays counted."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((bytes_of(column[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(column, F.lit(24).cast("long"), lambda a, x: a + bytes_of(x, kind.elementType)), F.lit(24).cast("long"))
    return F.lit(8).cast("long")


def hinted(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Broadcast a written table whose bytes, all counted, stay within ``most``; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if fits(df, most) else df


def fits(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    row = sum((bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return (df.agg(F.sum(row)).first()[0] or 0) <= most


def join_groups(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int, inner: bool = False) -> DataFrame:
    """Left (or inner) join of ``rows`` with ``groups`` (one row a key, ``weight`` rows each in ``rows``) that stands hot keys.

    Groups with more than a thousandth of all ``total`` rows number under 1000 whatever the input, so they
    are broadcast; the shuffled join of the others never sees their rows' keys. Columns of ``groups`` are
    null where a row has no group.
    """
    limit = max(LIGHT, total // 1000)
    values = [c for c in groups.columns if c != key]
    heavy = groups.where(F.col(weight) > limit).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv"))
    light = groups.where(F.col(weight) <= limit).select(F.col(key).alias("_lk"), F.struct(*values).alias("_lv"), F.lit(0).cast("long").alias("_ls"))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    # A row of a heavy group matches none of the light ones: its own number spreads such rows over all tasks.
    out = out.withColumn("_s", F.when(F.col("_hv").isNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1))
    out = out.join(light, (F.col(key) == F.col("_lk")) & (F.col("_s") == F.col("_ls")), "left").withColumn("_v", F.coalesce("_hv", "_lv"))
    if inner:
        out = out.where(F.col("_v").isNotNull())
    return out.select(*rows.columns, *(F.col("_v")[c].alias(c) for c in values))
