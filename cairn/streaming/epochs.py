"""Epochs as micro-batches: a sink, admission of late writes, range bounds that move, leases."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.prefix import running
from cairn.operators.ranges import RangeTable
from cairn.plans.options import Options
from cairn.sources.epoch_table import _put_meta, write_table


def event_epoch(time: Column, start: str, width_days: int = 1) -> Column:
    """Index of the window of ``width_days`` days that holds ``time``, the first one beginning at ``start``."""
    return F.floor(F.datediff(F.to_date(time), F.lit(start).cast("date")) / width_days).cast("int")


def in_epochs(time: Column, start: str, low: int | None = None, high: int | None = None, width_days: int = 1) -> Column:
    """``low <= event_epoch(time) < high`` as bounds on the time itself, which reach the scan."""
    at = lambda epoch: F.lit(str(date.fromisoformat(start) + timedelta(days=epoch * width_days))).cast("date")
    out = F.lit(True)
    if low is not None:
        out = out & (time >= at(low))
    return out if high is None else out & (time < at(high))


def admitted(rows: DataFrame, order: list[str], epoch: str = "epoch") -> DataFrame:
    """``rows`` in order of arrival, with ``late``: an epoch below one that has been seen before."""
    out = running(rows, order, F.col(epoch), "__seen", "max")
    return out.withColumn("late", F.coalesce(F.col(epoch) < F.col("__seen"), F.lit(False))).drop("__seen")


def write_epochs(stream: DataFrame, path: str, checkpoint: str, options: Options | None = None, epoch: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch of (key, value, seq) as the epoch of its batch number.

    A batch that is run again overwrites its own epoch, so that a restart does not double rows. With ``epoch``, rows whose
    own epoch is not the batch's go to ``rejected`` instead of failing the batch.
    """
    options = (options or Options()).clamped()

    def put(batch: DataFrame, number: int) -> None:
        if epoch is not None:
            batch = batch.persist()
            batch.where(F.col(epoch) != number).write.mode("overwrite").parquet(f"{path}/rejected/epoch={number}")
        rows = batch if epoch is None else batch.where(F.col(epoch) == number)
        write_table(rows, path, options, number, 0, overwrite=True)
        _put_meta(batch.sparkSession, path, options, number + 1, False)
        if epoch is not None:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish(spark: SparkSession, path: str, query: StreamingQuery) -> None:
    """Drain a query, stop it and seal its table."""
    from cairn.sources.epoch_table import _get_meta

    query.processAllAvailable() if query.isActive else None
    query.stop()
    options, epochs, _ = _get_meta(spark, path)
    _put_meta(spark, path, options, epochs, True)


def put_ranges(table: RangeTable, batch: DataFrame, number: int, key: str = "fkey") -> None:
    """One micro-batch by range; its observed range becomes the expected one of the next. The same batch again changes nothing."""
    batch = batch.persist()
    try:
        table.add(batch, number, key, batch=number)
        low, high = batch.agg(F.min(key), F.max(key)).first()
    finally:
        batch.unpersist()
    if low is not None:
        table.update_bounds(float(low), float(high))


def write_ranges(stream: DataFrame, table: RangeTable, checkpoint: str, key: str = "fkey") -> StreamingQuery:
    """Write micro-batches by range, each by the range that the one before was seen to have."""
    put = lambda batch, number: put_ranges(table, batch, number, key)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LEASE_STATE = "seq long, due long"
LEASE_OUT = "name string, at long, seq long, due long, granted boolean"


def lease_step(state: tuple[int, int] | None, at: int, change: bool, duration: int) -> tuple[tuple[int, int], bool]:
    """One call on a lease of (seq, due). A lookup shares the lease until it is due; a change must wait for that, and counts."""
    seq, due = state or (0, 0)
    if not change:
        return (seq, due if at < due else at + duration), True
    return ((seq + 1, due), True) if at >= due else ((seq, due), False)


def leases(calls: DataFrame, duration: int) -> DataFrame:
    """(name, at, seq, due, granted) for a stream of (name, at, change); the state of a name goes once its lease is long due.

    ``at`` is in microseconds and given with the call: it is the event time too, so that results do not depend on the clock.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        some = pd.concat(list(batches)).sort_values(["at", "change"])
        rows = []
        for at, change in zip(some["at"], some["change"], strict=True):
            held, granted = lease_step(held, int(at), bool(change), duration)
            rows.append((key[0], int(at), held[0], held[1], granted))
        state.update(held)
        state.setTimeoutTimestamp(max((held[1] + 10 * duration) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=["name", "at", "seq", "due", "granted"])

    timed = calls.select("name", "at", "change", F.timestamp_micros("at").alias("t")).withWatermark("t", f"{max(1, duration // 1000)} milliseconds")
    return timed.groupBy("name").applyInPandasWithState(step, LEASE_OUT, LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
