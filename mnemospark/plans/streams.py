"""Queries that run as streams to their end and give what arrived."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.queries import SQL
from mnemospark.plans.registry import query
from mnemospark.session import shared_folder, table
from mnemospark.sources.change_log import ChangeLogSource
from mnemospark.streaming import limits


def _arrived(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives until nothing new comes, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("t1_change_log_stream", "select event_id + 1 as sequence, event_type, user_id from events")
def change_log_stream(spark, sf):
    """Events as a log in files whose sequences overlap, read page by page."""
    spark.dataSource.register(ChangeLogSource)
    log = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    entries = table(spark, sf, "events").select((F.col("event_id") + 1).alias("sequence"), "event_type", "user_id")
    entries.repartition(4).write.parquet(log)
    stream = spark.readStream.format("change_log").schema(entries.schema).option("path", log).option("max_rows", 4096).option("max_bytes", 1 << 24).load()
    return _arrived(stream, "t1-stream")


@query("t3_rate_limit_stream", SQL["t3_rate_limit"])
def rate_limit_stream(spark, sf):
    spark.conf.set(*limits.STATE_STORE)
    events = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    source = f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    return _arrived(limits.fixed_window_stream(stream, "user_id", "ts", "event_id", limit=3, seconds=86400), "t3-stream")
