"""Continuous forms: Structured Streaming over folders of Parquet, with checkpoints in place of leases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.sources.tables import journal, journaled


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(events: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Each key once; state is let go `delay` after the latest event."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def ingest_status(events: DataFrame, key: str, content: str, order: str, time: str | None = None, keep_seconds: int = 7 * 86400, delay: str = "1 day") -> DataFrame:
    """key, content, status: accepted, duplicate (same content again) or conflict. State per key: the first content. Of the
    rows of a key that one batch brings, the one with the least `order` comes first, so a batch that is repeated gives
    the same; a task holds narrow columns of one key of one batch, which the source's files per trigger bound.

    With an event time, state ends: a key is let go `keep_seconds` after its latest event, once the watermark (`delay`
    behind the latest event of all) has passed that. Rows from before the watermark are left out by Spark; `late_aside`
    keeps them."""
    keep = keep_seconds * 1000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([b[[content, order, *([time] if time else [])]] for b in batches]).sort_values(order, kind="stable")
        known = state.exists
        first, latest = state.get if known else (rows[content].iloc[0], 0)
        same = rows[content].isna() if pd.isna(first) else rows[content] == first
        status = same.map({True: "duplicate", False: "conflict"}).astype(object)
        if not known:
            status.iloc[0] = "accepted"
        if time:
            latest = max(latest, int(pd.to_datetime(rows[time]).max().timestamp() * 1000))
            state.update((first, latest))
            state.setTimeoutTimestamp(max(latest + keep, state.getCurrentWatermarkMs() + 1))
        elif not known:
            state.update((first, latest))
        yield pd.DataFrame({key: [k[0]] * len(rows), content: rows[content].to_numpy(), "status": status.to_numpy()})

    kinds = dict(events.dtypes)
    out = f"`{key}` {kinds[key]}, `{content}` {kinds[content]}, status string"
    marked = events.withWatermark(time, delay) if time else events
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return marked.groupBy(key).applyInPandasWithState(step, out, f"first {kinds[content]}, latest long", "append", timeout)


def late_aside(path: str, time: str, delay_seconds: int, fresh: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A handler for `relay` that parts a batch: rows whose time lies more than `delay_seconds` behind the latest one of
    earlier batches go to `late`, the others to `fresh`. The latest time seen is journaled per batch number below `path`,
    so a batch that is handed on again is parted in the same way."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = journaled(spark, path, str(number - 1)) if number else None
        seen = before["latest"] if before else None
        at = F.unix_seconds(F.col(time).cast("timestamp"))
        own = batch.agg(F.max(at).alias("m")).first().m
        latest = max((x for x in (seen, own) if x is not None), default=None)
        journal(spark, path, str(number), {"latest": latest})
        behind = F.lit(False) if seen is None else F.coalesce(at < int(seen) - delay_seconds, F.lit(False))
        late(batch.where(behind), number)
        fresh(batch.where(~behind), number)

    return handle


def exposure_windows(assignments: DataFrame, time: str, seconds: int, delay: str) -> DataFrame:
    """Tumbling exposure counters. Windows count from 1970; where `seconds` divides a day that is the year-1 alignment."""
    w = F.window(time, f"{seconds} seconds")
    return assignments.withWatermark(time, delay).groupBy(w.alias("w"), "tenant_id").agg(F.count("*").alias("exposures"), F.count_if("unsafe").alias("unsafe"))


def relay(outbox: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint_dir: str, once: bool = True, every: str = "1 second"):
    """Hand each micro-batch of the outbox to `handle`, which must be idempotent per batch number: a batch is handed on
    again after a crash, never skipped."""
    writer = outbox.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
