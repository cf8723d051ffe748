"""Requests and their frames, as batches and as streams: assembly, throttling, time limits, debouncing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDLE_SECONDS, MAX_AGE_SECONDS = 600, 10800
FLUSH = "50 milliseconds"
SAVE_SECONDS = 1.5


def assembled(tokens: DataFrame) -> DataFrame:
    """request_id, text, tokens: a request's tokens (seq, token) in order."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]), "")
    return tokens.groupBy("request_id").agg(text.alias("text"), F.count("*").alias("tokens"))


def reclaimed(frames: DataFrame, key: str, now: str, idle: int = IDLE_SECONDS, age: int = MAX_AGE_SECONDS) -> DataFrame:
    """key, reason, frames at a time: maxAge for requests that began too long ago, else stalled for those without a
    frame for too long, else null. Two aggregates before the shuffle."""
    at = F.lit(now).cast("timestamp_ntz")
    df = frames.where(F.col("ts") <= at).groupBy(key).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.count("*").alias("frames"))
    since = lambda c: F.timestamp_diff("SECOND", F.col(c), at)
    return df.select(key, F.when(since("_a") > age, "maxAge").when(since("_b") > idle, "stalled").alias("reason"), "frames")


def debounced(changes: DataFrame, key: str, seconds: float = SAVE_SECONDS) -> DataFrame:
    """The changes that are saved: those with no later one of their key within ``seconds``."""
    later = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    df = changes.withColumn("_next", later)
    gap = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("_next"))
    return df.where(F.col("_next").isNull() | (gap > int(seconds * 1_000_000))).drop("_next")


def sticky(requests: DataFrame, model: str, order: str, bucket: str) -> DataFrame:
    """requests with num_ctx, the largest window that their model has needed so far."""
    so_far = Window.partitionBy(model).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("num_ctx", F.max(bucket).over(so_far))


def idle_sessions(frames: DataFrame, key: str, gap: str) -> DataFrame:
    """key, begun, ended, frames of each run of frames without a gap of that length; works on streams with a watermark."""
    df = frames.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("frames"))
    return df.select(key, F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "frames")


# ---- streams


def batched_tokens(stream: DataFrame, every: str = FLUSH, late: str = "10 seconds") -> DataFrame:
    """A stream of (request_id, seq, token, ts): what each request got in each short window, in order."""
    df = stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "request_id")
    parts = F.sort_array(F.collect_list(F.struct("seq", "token")))
    df = df.agg(F.array_join(F.transform(parts, lambda x: x["token"]), "").alias("text"))
    return df.select("request_id", F.col("w.start").alias("at"), "text")


def latest_state(stream: DataFrame, key: str = "request_id") -> DataFrame:
    """A stream's latest row for each key, for update or complete mode: only the newest request may write."""
    rest = [c for c in stream.columns if c not in (key, "seq")]
    df = stream.groupBy(key).agg(F.max("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("_row"))
    return df.select(key, "seq", "_row.*")


def reclaim_stream(stream: DataFrame, idle: int = IDLE_SECONDS, age: int = MAX_AGE_SECONDS) -> DataFrame:
    """A stream of (request_id, ts) with event time: request_id, reason, frames when a request is idle or too old.

    State of a request is its first and last time and its count; a timer at the nearer limit ends it.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            reason = "maxAge" if state.getCurrentWatermarkMs() - first > 1000 * age else "stalled"
            state.remove()
            yield pd.DataFrame({"request_id": [key[0]], "reason": [reason], "frames": [n]})
            return
        first, last, n = state.get if state.exists else (1 << 62, 0, 0)
        for f in frames:
            ms = f["ts"].astype("datetime64[ms]").astype("int64")
            first, last, n = min(first, int(ms.min())), max(last, int(ms.max())), n + len(f)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(min(last + 1000 * idle, first + 1000 * age), state.getCurrentWatermarkMs() + 1))

    return (
        stream.withWatermark("ts", "1 second")
        .groupBy("request_id")
        .applyInPandasWithState(run, "request_id long, reason string, frames long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def single_writer(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """A query that writes the latest row of each key of every batch; one batch writes at a time, each to its own
    folder, so a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        from pageloom.operators.store import latest_only

        latest_only(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
