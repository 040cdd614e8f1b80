"""Streams into stored tensors: micro-batches become versions, events become cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.group import AGGREGATES
from gridloom.tensor import Tensor


def windowed_cells(stream: DataFrame, time_col: str, dims: list[str], value_col: str, func: str = "sum", window: str = "1 day", slide: str | None = None, watermark: str | None = "1 day") -> DataFrame:
    """Event-time windows as a dimension: (window_start, dims..., value). Late rows beyond the watermark go."""
    rows = stream.withWatermark(time_col, watermark) if watermark else stream
    w = F.window(F.col(time_col), window, slide) if slide else F.window(F.col(time_col), window)
    out = rows.groupBy(w.alias("w"), *dims).agg(AGGREGATES[func](F.col(value_col), F.col(time_col)).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), *dims, "value")


def session_cells(stream: DataFrame, time_col: str, dims: list[str], value_col: str, gap: str = "30 minutes", func: str = "sum", watermark: str | None = "1 hour") -> DataFrame:
    """Sessions that a gap ends, as cells: (session_start, session_end, dims..., value)."""
    rows = stream.withWatermark(time_col, watermark) if watermark else stream
    out = rows.groupBy(F.session_window(F.col(time_col), gap).alias("s"), *dims).agg(AGGREGATES[func](F.col(value_col), F.col(time_col)).alias("value"))
    return out.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *dims, "value")


def deduplicated(stream: DataFrame, keys: list[str], time_col: str, watermark: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(keys)


def filled(stream: DataFrame, time_col: str, dims: list[str], value_col: str, watermark: str = "1 day", keep: str = "7 days") -> DataFrame:
    """A stream's cells with missing ones carried forward from the last valid cell of their series, also from
    earlier micro-batches: (time, dims..., value).

    The state of a series is its last valid value and time; it goes when the watermark has passed it by
    ``keep``. Cells of one micro-batch are taken in order of time; a valid cell older than the state's
    is passed on and does not change it; cells later than the watermark are dropped.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join([f"{time_col} timestamp", *(f"{d} {kinds[d]}" for d in dims), f"{value_col} double"])
    span = int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, at = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(time_col, kind="stable")
        out = []
        for t, v in zip(rows[time_col], rows[value_col]):
            ms = int(t.timestamp() * 1000)
            if not pd.isna(v):
                out.append(float(v))
                if ms >= at or last is None:
                    last, at = float(v), ms
            else:
                out.append(last if last is not None and ms >= at else None)
        if last is not None:
            state.update((last, at))
            state.setTimeoutTimestamp(max(at + span, state.getCurrentWatermarkMs() + 1))
        rows[value_col] = pd.array(out, "Float64").to_numpy(dtype=float, na_value=np.nan)
        yield rows[[time_col, *dims, value_col]]

    rows = stream.withWatermark(time_col, watermark).select(time_col, *dims, F.col(value_col).cast("double").alias(value_col))
    made = rows.groupBy(*dims).applyInPandasWithState(run, schema, "last double, at long", "append", "EventTimeTimeout")
    return made.withColumn(value_col, F.when(~F.isnan(value_col), F.col(value_col)))


def into_table(stream: DataFrame, table, dims: list[str], checkpoint: str, verb: str = "upsert", transform: Callable[[DataFrame], DataFrame] | None = None, name: str = "ingest", **trigger):
    """Write a stream to a stored tensor: each micro-batch is one version.

    A version carries the number of the batch that made it, published in the same step, so a batch that is
    replayed after a failure, wherever that was, finds its number and is not written twice. A ``transform``
    may therefore add to what is stored. ``name`` tells the streams into one table apart.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = table.tag(name)
        if (last is not None and last >= number) or batch.isEmpty():
            return
        rows = transform(batch) if transform else batch
        getattr(table, verb)(Tensor.from_dataframe(rows, dims), tag=(name, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
