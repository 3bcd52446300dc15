"""Streams: windowed aggregates, retention on arrival, expiry, and the log as a sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.log import is_write
from quillon.operators.timeseries import AGGREGATES, ALIASES


def windowed(stream: DataFrame, width: str, *names: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """stream(key, ts TIMESTAMP, value) -> (key, start, aggregates) by tumbling or sliding windows
    with a watermark."""
    names = [ALIASES.get(n.lower(), n.lower()) for n in names]
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy("key", span.alias("w")).agg(*(AGGREGATES[n]("value", "ts").alias(n) for n in names))
    return out.select("key", F.col("w.start").alias("start"), *names)


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of samples with no longer gap."""
    out = stream.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def retained(stream: DataFrame, retention_ms: int) -> DataFrame:
    """stream(key, ts_ms, value, seq) -> (key, n, first_ms, last_ms) after each micro-batch.

    State per key is its live samples. Retention follows arrival, not a watermark: each
    sample drops those older than its own time less the retention, and late samples stay until
    a newer one comes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(("ts_ms", "value"), state.get if state.exists else ([], []), strict=True))).astype({"ts_ms": "int64", "value": "float64"})
        fresh = pd.concat(list(frames)).sort_values("seq")[["ts_ms", "value"]]
        every = pd.concat([held, fresh], ignore_index=True)
        # a sample stays if none that came later is more than the retention ahead of it
        ahead = every["ts_ms"].iloc[::-1].cummax().iloc[::-1]
        live = every[every["ts_ms"] >= ahead - retention_ms].drop_duplicates("ts_ms", keep="last")
        state.update((live["ts_ms"].tolist(), live["value"].tolist()))
        yield pd.DataFrame({"key": [key[0]], "n": [len(live)], "first_ms": [live["ts_ms"].min()], "last_ms": [live["ts_ms"].max()]})

    return stream.groupBy("key").applyInPandasWithState(step, "key string, n bigint, first_ms bigint, last_ms bigint", "times array<bigint>, values array<double>", "update", GroupStateTimeout.NoTimeout)


def log_sink(stream: DataFrame, path: str, checkpoint: str):
    """Write commands go to an append-only table; every one arrives exactly once."""
    return stream.where(is_write(F.col("op"))).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
