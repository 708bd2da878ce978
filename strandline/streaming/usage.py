"""Usage counting and rate limiting on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def is_bot(agent: Column) -> Column:
    """Robots; an empty agent is one."""
    return F.coalesce(F.trim(agent), F.lit("")).rlike("(?i)^$|bot|crawl|spider|slurp|curl|wget|python")


def daily_usage(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests (ts, class, agent) per UTC day and class, readers and robots apart; batch or stream."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    bot = is_bot(F.col("agent"))
    counted = timed.groupBy(F.window("ts", "1 day").alias("w"), "class").agg(F.count_if(~bot).alias("readers"), F.count_if(bot).alias("bots"))
    return counted.select(F.to_date("w.start").alias("day"), "class", "readers", "bots")


def sliding_usage(requests: DataFrame, length: str, step: str, late: str) -> DataFrame:
    """Counts over sliding windows with a watermark."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length, step).alias("w"), "class").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "class", "n")


def sessions(requests: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key: requests less than ``gap`` apart."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("ends"), "n")


def take(tokens: float, at: float, now: float, burst: float, per_minute: float) -> tuple[float, int]:
    """The tokens left after a request and 0, or the seconds to wait."""
    tokens = min(burst, tokens + max(0.0, now - at) * per_minute / 60000)
    if tokens < 1:
        return tokens, int(-(-(1 - tokens) * 60 // per_minute))
    return tokens - 1, 0


def bucket_fold(rows: list[tuple[float, int]], burst: float, per_minute: float, state: tuple[float, float] | None = None) -> tuple[list[tuple[int, int]], tuple[float, float]]:
    """Requests (ms, id) of one key in order: (id, wait) of each, and the state after them."""
    tokens, at = state or (burst, rows[0][0] if rows else 0.0)
    out = []
    for now, number in sorted(rows):
        tokens, wait = take(tokens, at, now, burst, per_minute)
        at = now
        out.append((number, wait))
    return out, (tokens, at)


def token_bucket(requests: DataFrame, burst: float, per_minute: float, idle: str | None = "10 minutes") -> DataFrame:
    """Per key a bucket of tokens: (key, id, wait) for a stream of (key, id, ts), state kept between batches and dropped when idle (never, with ``idle`` None)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in batches:
            before = state.get if state.exists else None
            rows = [(t.timestamp() * 1000, int(i)) for t, i in zip(pdf["ts"], pdf["id"], strict=True)]
            out, after = bucket_fold(rows, burst, per_minute, before)
            state.update(after)
            yield pd.DataFrame({"key": [key[0]] * len(out), "id": [i for i, _ in out], "wait": [w for _, w in out]})
        if idle is not None:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))

    kind = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return requests.groupBy("key").applyInPandasWithState(run, "key string, id long, wait long", "tokens double, at double", "append", kind)


def token_bucket_batch(requests: DataFrame, burst: float, per_minute: float) -> DataFrame:
    """The same over a finished table: one sequential fold per key."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = bucket_fold([(t.timestamp() * 1000, int(i)) for t, i in zip(pdf["ts"], pdf["id"], strict=True)], burst, per_minute)
        return pd.DataFrame({"key": [key[0]] * len(out), "id": [i for i, _ in out], "wait": [w for _, w in out]})

    return requests.groupBy("key").applyInPandas(run, "key string, id long, wait long")


def stepwise(source: DataFrame, sink, checkpoint: str) -> None:
    """Read what is there in bounded steps and stop: ``sink(batch, number)`` per step; a later call goes on where this one ended."""
    source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start().awaitTermination()
