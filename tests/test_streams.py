"""Streams against what the same rows give as tables; kill and restart; states that expire."""

import os

import pytest
from pyspark.sql import functions as F

from mnemospark.sources.change_log import ChangeLogReader, ChangeLogSource
from mnemospark.streaming import change_log, limits

LOG = "sequence long, context string, at timestamp, note string"


def entries(spark, first, n):
    return spark.range(first, first + n).selectExpr("id as sequence", "concat('c', id % 7) as context", "timestamp_seconds(id) as at", "case when id % 3 = 0 then repeat('é', cast(id % 50 as int)) end as note")


def pages_of(spark, out):
    return {r["sequence"]: r["page"] for r in spark.read.parquet(out).collect()}


@pytest.mark.parametrize("rows,size", [(10, 10**6), (1000, 500)])
def test_change_log_stream_restarts_where_it_was(spark, tmp_path, rows, size):
    spark.dataSource.register(ChangeLogSource)
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    entries(spark, 1, 40).repartition(3).write.parquet(log)  # files whose sequences overlap
    options = {"path": log, "max_rows": str(rows), "max_bytes": str(size)}

    def run(fail_at=None):
        def keep(batch, n):
            if n == fail_at:
                raise RuntimeError("killed")
            batch.withColumn("page", F.lit(n)).write.mode("append").parquet(f"{out}/batch={n}")

        stream = spark.readStream.format("change_log").schema(LOG).options(**options).load()
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", check).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="killed"):
        run(fail_at=2)
    before = pages_of(spark, out)
    assert sorted(before) == list(range(1, len(before) + 1)) and len(before) < 40
    entries(spark, 41, 15).repartition(2).write.mode("append").parquet(log)
    run()
    after = pages_of(spark, out)
    assert sorted(after) == list(range(1, 56)) and {s: after[s] for s in before} == before
    assert spark.read.parquet(out).count() == 55
    # pages are those of delta_page(), and so are their cursors
    table, cursor, n = spark.read.schema(LOG).parquet(log), None, 0
    reader = ChangeLogReader(table.schema, options)
    offset = reader.initialOffset()
    while cursor is None or page[0]["has_more"]:
        page = change_log.delta_page(table, cursor, rows, size).orderBy("sequence").collect()
        got, offset = reader.read(offset)
        assert [r[0] for r in got] == [r["sequence"] for r in page] and reader.cursor(offset) == page[0]["next_cursor"]
        cursor, n = page[0]["next_cursor"], n + 1
    assert n > 2 and list(reader.read(offset)[0]) == [] and [r[0] for r in reader.readBetweenOffsets({"last_sequence": 3}, {"last_sequence": 6})] == [4, 5, 6]


def test_change_log_options(spark):
    schema = spark.createDataFrame([], LOG).schema
    for bad in ({"max_rows": "0"}, {"max_bytes": "0"}, {"sequence": "none"}):
        with pytest.raises(ValueError):
            ChangeLogReader(schema, {"path": "/x", **bad})


def test_rate_limit_stream(spark, tmp_path):
    spark.conf.set(*limits.STATE_STORE)
    calls = [(1 + i % 3, i, 1000 + i * (7 if i % 3 else 40)) for i in range(120)] + [(9, 500, 10), (9, 501, 10), (9, 502, 10)]
    df = spark.createDataFrame(calls, "who long, call long, s long").select("who", "call", F.timestamp_seconds("s").alias("at"))
    want = sorted(tuple(r) for r in limits.fixed_window(df, "who", "at", "call", limit=2, seconds=60).collect())
    assert not all(r[2] for r in want) and any(r[2] for r in want[10:])
    source, order = str(tmp_path / "in"), [500, 501, 502] + [c for _, c, _ in sorted(calls[:120], key=lambda x: x[2])]
    os.makedirs(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = limits.fixed_window_stream(stream, "who", "at", "call", limit=2, seconds=60)
    q = found.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for i in range(0, len(order), 41):
            df.where(F.col("call").isin(order[i : i + 41])).coalesce(1).write.mode("append").parquet(source)
            q.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("limited").collect()) == want
        # a call long after: all windows before it are over, so their states go
        spark.createDataFrame([(77, 999, 10**6)], "who long, call long, s long").select("who", "call", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(source)
        q.processAllAvailable()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert states[-1] < max(states)
    finally:
        q.stop()
    with pytest.raises(ValueError):
        limits.fixed_window_stream(stream, "who", "at", "call", limit=0, seconds=1)


def test_deduplicated_and_counted_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    source = str(tmp_path / "in")
    events.where("event_id <= 400").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    q = change_log.windowed_counts(stream, "ts", ["event_type"], "value", "1 hour", late="0 seconds").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    events.where("event_id = 401").withColumn("ts", F.expr("timestamp '2200-01-01'")).coalesce(1).write.mode("append").parquet(source)  # closes all windows
    q.processAllAvailable()
    q.stop()
    want = change_log.windowed_counts(events.where("event_id <= 400"), "ts", ["event_type"], "value", "1 hour")
    near = lambda rows: sorted((r["window_start"], r["event_type"], r["n"], round(r["total"], 6)) for r in rows)
    assert near(spark.table("hours").collect()) == near(want.collect())

    twice = str(tmp_path / "twice")
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 10), (3, "b", 20), (4, "a", 30)], "n long, k string, s long").select("n", "k", F.timestamp_seconds("s").alias("at"))
    rows.coalesce(1).write.parquet(twice)
    q = change_log.deduplicated(spark.readStream.schema(rows.schema).parquet(twice), ["k"], "at", "1 hour").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    later = spark.createDataFrame([(5, "a", 60), (6, "c", 90_000)], "n long, k string, s long").select("n", "k", F.timestamp_seconds("s").alias("at"))
    later.coalesce(1).write.mode("append").parquet(twice)
    q.processAllAvailable()
    q.stop()
    assert sorted(r["k"] for r in spark.table("once").collect()) == ["a", "b", "c"]
