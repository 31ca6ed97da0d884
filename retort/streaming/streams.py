"""Stateless plans and windowed counts on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions.shared import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet files called name under folder, as a stream of the same schema."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}*")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run over all that is there, to a parquet sink in the shared folder, and read the result."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def q_stream_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as data on a stream: the JSON property of an event, -1 where it is not a number under 50."""
    e = file_stream(spark, sf_dir, "events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    return run_available(e.select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.when(k < 50, k).otherwise(-1).alias("k")))


QUERIES = {"stream_parity": q_stream_parity}
ORACLE_SQL = {"stream_parity": "SELECT event_id, date_trunc('hour', ts) AS hour, CASE WHEN CAST(props->>'$.k' AS BIGINT) < 50 THEN CAST(props->>'$.k' AS BIGINT) ELSE -1 END AS k FROM events"}
