"""Frame files (``stream|label|hex``, one frame per line) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "stream string, label string, hex string"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(stream, label, frame); lines without a frame are left out."""
    lines = spark.read.schema(SCHEMA).option("sep", "|").csv(path)
    return lines.select("stream", "label", F.unhex("hex").alias("frame")).where("frame is not null")


def write_frames(df: DataFrame, path: str) -> None:
    """Writes (stream, label, frame) in the same form."""
    df.select(F.concat_ws("|", "stream", "label", F.lower(F.hex("frame")))).write.text(path)
