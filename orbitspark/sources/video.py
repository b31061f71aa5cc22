"""Video probes: captured JSON of a prober, read as rows; refusals are rows too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.functions.measures import parse_rate, snap_rotation
from orbitspark.schemas import VIDEO_JSON

#: Containers and codecs that are taken.
CONTAINERS, CODECS = ("mp4", "mov"), ("h264", "hevc")


def containers(format_name: Column) -> Column:
    return F.filter(F.transform(F.split(format_name, ","), lambda x: F.trim(x)), lambda x: x != "")


def probe(rows: DataFrame, json: str = "json") -> DataFrame:
    """Properties of each probed file, with exit code 2 and a reason where it is not usable."""
    d = rows.withColumn("_p", F.from_json(json, VIDEO_JSON))
    s = F.get(F.filter("_p.streams", lambda x: x["codec_type"] == "video"), F.lit(0))
    d = d.withColumn("_s", s).withColumn("_c", containers(F.col("_p.format.format_name")))
    container = F.when(F.lower("path").endswith(".mp4") & F.array_contains("_c", "mp4"), F.lit("mp4")).otherwise(F.get("_c", F.lit(0)))
    side = F.get(F.filter(F.transform("_s.side_data_list", lambda x: x["rotation"]), lambda x: x.isNotNull()), F.lit(0))
    tag = F.element_at("_s.tags", "rotate").try_cast("double")
    rotation = F.coalesce(snap_rotation(side), snap_rotation(-tag), F.lit(0))
    ok_container, ok_codec = F.arrays_overlap("_c", F.array(*map(F.lit, CONTAINERS))), F.col("_s.codec_name").isin(*CODECS)
    reason = (
        F.when(F.col("_p").isNull(), "the probe's output can't be read").when(F.col("_s").isNull(), "no video stream").when(~F.coalesce(ok_container, F.lit(False)), F.concat(F.lit("container is not supported: "), F.col("container")))
        .when(~F.coalesce(ok_codec, F.lit(False)), F.concat(F.lit("codec is not supported: "), F.col("video_codec")))
    )
    out = d.select(
        *rows.columns, "_p", "_s", "_c", container.alias("container"), F.col("_s.codec_name").alias("video_codec"), F.coalesce(F.col("_s.duration").try_cast("double"), F.col("_p.format.duration").try_cast("double")).alias("duration_s"),
        F.coalesce(parse_rate(F.col("_s.avg_frame_rate")), parse_rate(F.col("_s.r_frame_rate"))).alias("avg_fps"), F.col("_s.width").alias("width"), F.col("_s.height").alias("height"), rotation.alias("rotation_deg"),
        F.col("_s.nb_frames").try_cast("long").alias("nb_frames"), F.col("_p.format.size").try_cast("long").alias("size_bytes"),
    )
    return out.withColumn("reason", reason).withColumn("exit_code", F.when(F.col("reason").isNotNull(), 2).otherwise(0)).drop("_p", "_s", "_c")
