"""Structured Streaming forms: sessions, live segments, usage windows, idempotent intake, late rows.

Each takes and gives a streaming DataFrame (or a batch one, with the same
result), but for the intake, which is a foreachBatch function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from spanloom.functions.scalars import price

#: The state store that transformWithState needs: spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessions(events: DataFrame, gap_s: float, delay: str = "1 hour") -> DataFrame:
    """Sessions of (stream_id, title, ts, seconds): rows of a title belong together while at most gap_s passes from the end of one to the start of the next."""
    zero = F.lit(0)
    gap = F.make_interval(zero, zero, zero, zero, zero, zero, (F.col("seconds") + F.lit(gap_s)).cast("decimal(18,6)"))
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy("stream_id", "title", w.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("stream_id", "title", "n", "first_ts", "last_ts")


def usage_windows(usage: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Calls, tokens and cost of (ts, phase, hit, miss, completion) by phase in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = usage.withWatermark("ts", delay).groupBy(w.alias("w"), "phase").agg(F.count("*").alias("calls"), F.sum("hit").alias("hit"), F.sum("miss").alias("miss"), F.sum("completion").alias("completion"))
    return rows.select(F.col("w.start").alias("from_ts"), "phase", "calls", "hit", "miss", "completion", price(F.col("hit"), F.col("miss"), F.col("completion")).alias("cost_usd"))


class _Segmenter(StatefulProcessor):
    """One open segment of each stream: words join it until a gap, or until it would grow too long; a timer closes the last one."""

    def __init__(self, gap_s: float, cap_s: float):
        self.gap_s, self.cap_s = gap_s, cap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_s double, end_s double, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        words = pd.concat(list(rows)).dropna(subset=["start_s", "end_s"])
        words = words[words["word"].fillna("").str.strip() != ""].sort_values(["start_s", "end_s"])
        now = self.open.get() if self.open.exists() else None
        out = []
        for start, end, word in zip(words["start_s"], words["end_s"], words["word"]):
            if now is not None and start - now[1] <= self.gap_s and end - now[0] <= self.cap_s:
                now = (now[0], max(now[1], end), now[2] + word)
            else:
                if now is not None:
                    out.append((key[0], *now))
                now = (float(start), float(end), str(word))
        if now is not None:
            self.open.update(now)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0])
            self.handle.registerTimer(int((now[1] + self.gap_s) * 1000) + 1)
        yield pd.DataFrame(out, columns=["stream_id", "start_s", "end_s", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield pd.DataFrame([(key[0], *self.open.get())], columns=["stream_id", "start_s", "end_s", "text"])
            self.open.clear()

    def close(self) -> None:
        pass


def live_segments(words: DataFrame, gap_s: float, cap_s: float, delay: str = "10 seconds") -> DataFrame:
    """Segments of words (stream_id, ts, start_s, end_s, word): cut at gaps above gap_s and before growing longer than cap_s.

    ts is the event time of start_s; a segment goes out when the next one
    begins, or when the watermark has passed its end by gap_s.
    """
    schema = "stream_id long, start_s double, end_s double, text string"
    grouped = words.withWatermark("ts", delay).groupBy("stream_id")
    return grouped.transformWithStateInPandas(_Segmenter(gap_s, cap_s), schema, "Append", "EventTime")


def intake(state_path: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that works on keys without a success in the state table, and records how it went.

    State rows are appended with the batch number, so a batch that runs twice does no harm.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        schema = StructType.fromDDL("stream_id long, status string, epoch long")
        try:
            state = spark.read.schema(schema).parquet(state_path)
            done = state.where((F.col("status") == "success") & (F.col("epoch") != epoch)).select("stream_id").distinct()
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], "stream_id long")
        todo = batch.dropDuplicates(["stream_id"]).join(done, "stream_id", "left_anti")
        out = work(todo).select("stream_id", "status").withColumn("epoch", F.lit(epoch).cast("long"))
        out.write.mode("append").parquet(state_path)

    return run


def late_rows(batch: DataFrame, seen_to: str | Column, delay: str) -> DataFrame:
    """Rows of a batch older than what was seen before it by more than delay: those a watermark drops."""
    seen = seen_to if isinstance(seen_to, Column) else F.lit(seen_to).cast("timestamp")
    return batch.where(F.col("ts") < seen - F.expr(f"interval {delay}"))


def route_late(late_path: str, seen_path: str, delay: str, on_time: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps rows behind the watermark: they go to a side table by batch, the others to on_time.

    What was seen before a batch is the greatest ts of all earlier ones, kept in a
    table of one row a batch, so it holds over restarts. Each batch writes under
    its own number and replaces what it wrote before, so one that runs twice does
    no harm.
    """
    schema = StructType.fromDDL("seen_to timestamp, epoch long")

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(seen_path).where(F.col("epoch") < epoch).agg(F.max("seen_to")).first()[0]
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = None
        late = late_rows(batch, F.lit(seen).cast("timestamp"), delay) if seen is not None else batch.where("false")
        late.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{late_path}/batch={epoch}")
        rest = batch if seen is None else batch.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(seen).cast("timestamp") - F.expr(f"interval {delay}")))
        on_time(rest, epoch)
        batch.agg(F.max("ts").alias("seen_to")).where("seen_to is not null").withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{seen_path}/batch={epoch}")

    return run
