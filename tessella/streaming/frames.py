"""Streaming forms of the frame operators.

Frames may come late and out of order. Each waits in its sequence's state until the watermark, the latest time seen anywhere
less a delay, has passed it, and is then handled in its place; a timer on the earliest frame that waits calls the
sequence again when none of its frames come. What comes later than the delay allows is dropped by the watermark. A sequence
of which nothing has come for ``idle`` leaves the store. The last frames of a stream that ends are due when something later
has come: see ``closing``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a row says to a sequence's memory: (memory or None, place, payload) to (memory, columns to put out).
Step = Callable[[list[float] | None, int, list[float]], tuple[list[float], tuple]]


def in_order(stream: DataFrame, key: str, place: str, payload: Column, at: str, delay: str, idle: int | None, step: Step, out: str) -> DataFrame:
    """``out`` (key, place and what ``step`` gives) of a stream's rows, handled by time (``at``) and place within each key.

    payload: an array of doubles; rows where it is null are no frames, but move the watermark. State of a key: ``step``'s
    memory (numbers), when it is forgotten, and the rows that wait. ``idle``: milliseconds.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, until, places, times, payloads = state.get if state.exists else (None, None, [], [], [])
        waiting = list(zip(times, places, payloads, strict=True))
        passed = state.getCurrentWatermarkMs()
        if until is not None and passed >= until:
            memory = None
        if not state.hasTimedOut:
            for rows in parts:
                ms = rows["at"].astype("datetime64[ms]").astype("int64")
                waiting += [(int(t), int(p), list(map(float, v))) for t, p, v in zip(ms, rows["place"], rows["payload"], strict=True) if v is not None]
        found = []
        for _, p, v in sorted(w for w in waiting if w[0] < passed):
            memory, values = step(None if memory is None else list(memory), p, v)
            found.append((group[0], p, *values))
        waiting = sorted(w for w in waiting if w[0] >= passed)
        if memory is None and not waiting:
            if state.exists:
                state.remove()
        else:
            until = passed + idle if idle is not None and not waiting else None
            state.update((memory, until, *([w[c] for w in waiting] for c in (1, 0, 2))))
            if waiting:
                state.setTimeoutTimestamp(max(waiting[0][0] + 1, passed + 1))
            elif until is not None:
                state.setTimeoutTimestamp(until)
        yield pd.DataFrame(found, columns=names)

    rows = stream.withWatermark(at, delay).select(F.col(key).alias("key"), F.col(place).cast("long").alias("place"), payload.alias("payload"), F.col(at).alias("at"))
    state = "memory array<double>, until long, places array<long>, times array<long>, payloads array<array<double>>"
    return rows.groupBy("key").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def closing(rows: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """A row of no payload for each key, later than all of rows by twice the delay, that ends a stream of them."""
    last = rows.groupBy(key).agg(F.max(at).alias(at))
    end = last.agg(F.max(at).alias("end")).select((F.col("end") + 2 * F.expr(f"interval {delay}")).alias(at))  # one row
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes if c not in (key, at)]
    return last.select(key).join(F.broadcast(end)).select(key, at, *empty).select(*rows.columns)


def shots(frames: DataFrame, threshold: int, delay: str = "10 days", idle: int | None = None) -> DataFrame:
    """seq, frame, diff, changed, shot of a stream of frames (seq, frame, hist, at: timestamp), as ``operators.frames.shots``."""

    def step(memory: list[float] | None, frame: int, hist: list[float]) -> tuple[list[float], tuple]:
        diff = 0 if memory is None else int(np.abs(np.asarray(hist) - np.asarray(memory[1:])).sum())
        changed = memory is None or diff > threshold
        shot = (-1 if memory is None else int(memory[0])) + changed
        return [float(shot), *hist], (diff, changed, shot)

    kind = dict(frames.dtypes)["seq"]
    return in_order(frames, "seq", "frame", F.col("hist").cast("array<double>"), "at", delay, idle, step, f"seq {kind}, frame long, diff long, changed boolean, shot int")


def moments(pixels: DataFrame) -> DataFrame:
    """Mean and population deviation of all values so far; for output mode "complete"."""
    return pixels.agg(F.avg("val").alias("mean"), F.stddev_pop("val").alias("std"))


def rolling(values: DataFrame, window: int = 20, delay: str = "10 days", idle: int | None = None) -> DataFrame:
    """key, step, value, median, mean of a stream of values (key, step, value, at: timestamp), over each value and up to
    ``window`` - 1 before it with the same key; the median is the lower one of an even number."""

    def step(memory: list[float] | None, place: int, payload: list[float]) -> tuple[list[float], tuple]:
        last = [*(memory or []), payload[0]][-window:]
        return last, (payload[0], sorted(last)[(len(last) - 1) // 2], sum(last) / len(last))

    kind = dict(values.dtypes)["key"]
    payload = F.when(F.col("value").isNotNull(), F.array(F.col("value").cast("double")))
    return in_order(values, "key", "step", payload, "at", delay, idle, step, f"key {kind}, step long, value double, median double, mean double")


def appended(stream: DataFrame, path: str, state: str) -> None:
    """Runs an append-mode stream over what its source has, into Parquet files; a batch that runs again is not
    written twice, as the sink's log names the files of each."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def replaced(stream: DataFrame, path: str, state: str) -> None:
    """Runs a complete-mode stream over what its source has; each batch replaces the table of its own number, so running one
    again does no harm, and the highest number holds the result."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
