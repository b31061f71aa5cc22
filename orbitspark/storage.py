"""Tables that cut lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast.
MOST_BROADCAST = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets a temporary folder, any other master is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="orbitspark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: not computed again, and there when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/orbitspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, rows: int, row_bytes: int = 256) -> DataFrame:
    """Broadcast a table of ``rows`` rows, counted by the caller, if they take no more than ``MOST_BROADCAST`` at ``row_bytes`` each; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= MOST_BROADCAST else df
