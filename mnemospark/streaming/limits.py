"""Rate limits in windows that begin with a subject's first call."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fixed_window(calls: DataFrame, subject: str, time: str, call: str, limit: int, seconds: int) -> DataFrame:
    """subject, call, allowed, remaining, retry_after of each call. A window begins with the first
    call that no window holds and lasts so many seconds; its first limit calls are allowed.
    retry_after: whole seconds until the window ends, at least 1.

    Windows aren't aligned to a clock, so where one begins depends on those before. But after a pause
    of a window's length one begins whatever came before, so a subject's calls are cut there and its
    parts are dealt to tasks. The pauses are found among the first and last calls of each stretch of
    that length, a row each. The calls of a part are read in order, batch by batch, and only the open
    window is carried on: calls without a pause take time in one task, but no memory."""
    if limit < 1 or seconds < 1:
        raise ValueError("limit and seconds must be positive")
    width = seconds * 1_000_000

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: tuple = (None, 0, 0)  # subject, begin of its window, calls in it so far
        for batch in batches:  # a part's first call is beyond the window of the part before, so parts need no mark
            t, who = batch["_t"].to_numpy(), batch[subject].to_numpy()
            count, ends = np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64)
            i = 0
            turns = np.append(np.flatnonzero(who[1:] != who[:-1]) + 1, len(t))
            for stop in turns:
                while i < stop:
                    if open_[0] != who[i] or t[i] >= open_[1] + width:
                        open_ = (who[i], t[i], 0)
                    j = i + int(np.searchsorted(t[i:stop], open_[1] + width))
                    count[i:j] = open_[2] + np.arange(1, j - i + 1)
                    ends[i:j] = open_[1] + width
                    open_, i = (open_[0], open_[1], open_[2] + j - i), j
            wait = np.maximum((ends - t + 500_000) // 1_000_000, 1)
            yield pd.DataFrame({subject: who, call: batch[call], "allowed": count <= limit, "remaining": np.maximum(limit - count, 0), "retry_after": wait})

    kinds = dict(calls.dtypes)
    rows = calls.where(F.col(subject).isNotNull() & F.col(time).isNotNull()).select(subject, call, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"))
    rows = rows.withColumn("_d", F.expr(f"_t div {width}"))  # as it rounds, so near 1970 a stretch is twice as long: a pause is found by its length
    stretches = rows.groupBy(subject, "_d").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    order = Window.partitionBy(subject).orderBy("_d")
    pause = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) >= width, F.lit(True)).cast("int")
    parts = stretches.withColumn("_pause", pause).select(F.col(subject).alias("_s"), F.col("_d").alias("_e"), F.sum("_pause").over(order).alias("_part"))
    rows = rows.join(parts, (F.col(subject) == F.col("_s")) & (F.col("_d") == F.col("_e")))
    ordered = rows.select(subject, call, "_t", "_part").repartition(subject, "_part").sortWithinPartitions(subject, "_t", call)
    return ordered.mapInPandas(decide, f"{subject} {kinds[subject]}, {call} {kinds[call]}, allowed boolean, remaining long, retry_after long")


def fixed_window_stream(calls: DataFrame, subject: str, time: str, call: str, limit: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """fixed_window() over a stream of calls: a subject's open window is its state, which goes when the
    watermark has passed the window's end. Calls of a micro-batch are taken in order of their time, then of
    call; those beyond the watermark go. The session needs the RocksDB state store
    (STATE_STORE), and output mode append or update.

    A subject's calls of one micro-batch meet in one task, so a source's maxFilesPerTrigger or the like
    bounds them; what is carried from batch to batch is two numbers a subject."""
    from pyspark.sql.streaming import StatefulProcessor

    if limit < 1 or seconds < 1:
        raise ValueError("limit and seconds must be positive")
    kinds = dict(calls.dtypes)
    width = seconds * 1_000_000

    class Limiter(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.window = handle, handle.getValueState("window", "begin long, n long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values(["at_micros", call], kind="stable")
            begin, n = self.window.get() if self.window.exists() else (None, 0)
            was, out = begin, []
            for t in batch["at_micros"].tolist():
                if begin is None or t >= begin + width:
                    begin, n = t, 0
                n += 1
                out.append((n <= limit, max(limit - n, 0), max((begin + width - t + 500_000) // 1_000_000, 1)))
            self.window.update((begin, n))
            if was != begin:
                if was is not None:
                    self.handle.deleteTimer(-(-(was + width) // 1000))
                self.handle.registerTimer(-(-(begin + width) // 1000))
            allowed, remaining, wait = zip(*out, strict=True)
            yield pd.DataFrame({subject: batch[subject].to_numpy(), call: batch[call].to_numpy(), "allowed": allowed, "remaining": remaining, "retry_after": wait})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.window.exists() and self.window.get()[0] + width <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.window.clear()
            return iter(())

        def close(self) -> None:
            pass

    rows = calls.where(F.col(subject).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = rows.select(F.col(subject).alias("window_key"), subject, call, F.unix_micros(time).alias("at_micros"), time)
    schema = f"{subject} {kinds[subject]}, {call} {kinds[call]}, allowed boolean, remaining long, retry_after long"
    return rows.groupBy("window_key").transformWithStateInPandas(Limiter(), schema, "Append", "eventTime")


#: What a session needs for states with expiry.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
