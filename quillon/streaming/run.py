"""Runs a streaming plan over what is there and reads the result back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and Spark
    runs on one machine."""
    global _own
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _own = _own or tempfile.mkdtemp(prefix="quillon-stream-")
    return f"file://{_own}"


def drain(stream: DataFrame) -> tuple[DataFrame, str]:
    """Processes all input that is available into a table, exactly once; the
    table and its path."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/quillon/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows"), f"{at}/rows"


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
