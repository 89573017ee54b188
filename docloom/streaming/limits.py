"""Streams: rate limits, daily budgets, sessions and incremental refresh."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

_LOG = "times array<double>"


def admitted(times: list[float], log: list[float], window: float, most: int) -> tuple[list[bool], list[float]]:
    """Whether each request (ascending times) is let in, and the log afterwards; rejected ones are not logged."""
    out = []
    for t in times:
        log = [x for x in log if t - x < window]
        ok = len(log) < most
        if ok:
            log.append(t)
        out.append(ok)
    return out, log


def sliding_window_limit(requests: DataFrame, window_seconds: float, most: int) -> DataFrame:
    """Stream of key, at, admitted: at most `most` admitted requests (key, at) of a key in any window.

    The state is the log of admitted times within the window; keys idle for two
    windows are forgotten. That goes by the clock, so the query has batches even
    without data and runs until it is stopped.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at")
        ok, log = admitted([x.timestamp() for x in rows["at"]], log, window_seconds, most)
        state.update((log,))
        state.setTimeoutDuration(int(2000 * window_seconds))
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "admitted": ok})

    return requests.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, admitted boolean", _LOG, "append", "ProcessingTimeTimeout")


def limited_batch(requests: DataFrame, window_seconds: float, most: int) -> DataFrame:
    """The same over a finished log of requests (key, at, id)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "id"])
        rows["admitted"] = admitted([x.timestamp() for x in rows["at"]], [], window_seconds, most)[0]
        return rows

    rows = requests.select("key", "at", "id")
    return rows.groupBy("key").applyInPandas(one, StructType([*rows.schema.fields, StructField("admitted", BooleanType())]))


def daily_budget(requests: DataFrame, most: int, by: str = "key", at: str = "at", order: str = "id") -> DataFrame:
    """Requests with `admitted`: the first `most` of each key and UTC day."""
    from pyspark.sql import Window

    w = Window.partitionBy(by, F.to_date(at)).orderBy(at, order)
    return requests.withColumn("admitted", F.row_number().over(w) <= most)


def windowed_counts(events: DataFrame, at: str, late: str, width: str, by: str) -> DataFrame:
    """An extension: counts by event-time window and key, late rows admitted up to `late`."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def refresh_stream(staged: DataFrame, apply, checkpoint: str):
    """Run `apply(batch, batch_id)` on each micro-batch of all staged rows there are, then stop."""
    return staged.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
