"""Structured Streaming: windows with late data, duplicates, and a stateful segment chunker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, *, ts: str, key: str, value: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of tumbling windows; rows later than ``late`` are dropped, state is bounded by it."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = e.groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(key, F.col("window.start").alias("start"), "n", "total")


def distinct_within(events: DataFrame, *, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


CHUNK = "key string, start double, end double, n_segments int, text string"


def chunk_segments(segments: DataFrame, *, window: float = 30.0, min_chars: int = 40, idle_ms: int | None = 600_000) -> DataFrame:
    """Fixed windows of timed segments per key of a stream, anchored at the first start.

    segments: (key, start, end, text). A chunk is emitted when a segment crosses the end of
    its window; one with less than ``min_chars`` characters is dropped. The open chunk is the last
    one and is emitted, however short, when its key has been silent for ``idle_ms`` of processing
    time; with null it stays open (a run over what is available now would otherwise wait for it). State per key is one
    open window. Rows of a micro-batch are taken in order of start.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        origin, index, end, n, text = state.get if state.exists else (None, 0, 0.0, 0, "")
        out = []

        def flush(last=False):
            if n and text and (last or len(text) >= min_chars):
                out.append((key[0], origin + index * window, end, n, text))

        if state.hasTimedOut:
            flush(last=True)
            state.remove()
        else:
            rows = pd.concat(list(batches)).dropna(subset=["start"]).sort_values(["start", "end"])
            for s, e, t in zip(rows["start"], rows["end"], rows["text"].fillna("")):
                if origin is None:
                    origin = float(s)
                at = int((s - origin) // window)
                if at > index and n:
                    flush()
                    n, text = 0, ""
                if at > index:
                    index = at
                end, n, text = float(e) if e == e else float(s), n + 1, (text + " " + t).strip()
            if origin is not None:
                state.update((float(origin), int(index), float(end), int(n), text))
                if idle_ms is not None:
                    state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "start", "end", "n_segments", "text"])

    return segments.groupBy("key").applyInPandasWithState(
        step, CHUNK, "origin double, idx int, end double, n int, text string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )
