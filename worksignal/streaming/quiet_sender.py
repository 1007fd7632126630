"""Senders who went quiet, as a keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "tenant_id string, email string, item_count bigint, first_seen timestamp, last_seen timestamp"
_STATE = "item_count bigint, first_us bigint, last_us bigint, told boolean"
_PARTIAL = "tenant_id string, email string, seen timestamp, item_count bigint, first_us bigint, last_us bigint"
_DAY_MS = 86_400_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_HELD_ROWS = 200_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts).groupby(["tenant_id", "email"], as_index=False).agg(
        seen=("seen", "max"), item_count=("item_count", "sum"), first_us=("first_us", "min"), last_us=("last_us", "max")
    )


def _pre_aggregate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per sender and task, of so many senders as are held at once, so a very active sender shuffles little."""
    held, n = [], 0
    for batch in batches:
        held.append(_merged([batch.assign(item_count=1, first_us=batch["us"], last_us=batch["us"])]))
        n += len(held[-1])
        if n > _HELD_ROWS:
            held = [_merged(held)]
            n = len(held[0])
        if n > _HELD_ROWS // 2 and len(held) == 1:
            yield held.pop()
            n = 0
    if held:
        yield _merged(held)


class QuietSenders(StatefulProcessor):
    """A sender's counts, a timer for the day they are told of as quiet, and after it one for the day they are forgotten."""

    def __init__(self, quiet_days: int, forget_days: int) -> None:
        self._quiet_ms, self._forget_ms = quiet_days * _DAY_MS, forget_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", _STATE)

    def _wait(self, last_us: int, after_ms: int, watermark_ms: int) -> None:
        """One timer, `after_ms` behind the last mail. Timers tick in milliseconds and must lie ahead of the watermark."""
        self._handle.registerTimer(max(-(-last_us // 1000) + after_ms, watermark_ms + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Every call of the state goes to the JVM and back, which is most of a sender's time: a new sender has no timer to look for.
        known = self._seen.get()
        count, first_us, last_us, _ = known or (0, None, None, False)
        for row in rows:
            count += row.item_count
            first_us = row.first_us if first_us is None else min(first_us, row.first_us)
            last_us = row.last_us if last_us is None else max(last_us, row.last_us)
        self._seen.update((count, first_us, last_us, False))
        if known:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
        self._wait(last_us, self._quiet_ms, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # The timer that expired is the only one, and Spark deletes it.
        count, first_us, last_us, told = self._seen.get()
        if told:
            self._seen.clear()
            return
        self._seen.update((count, first_us, last_us, True))
        self._wait(last_us, self._forget_ms, timerValues.getCurrentWatermarkInMs())
        yield Row(
            tenant_id=key[0], email=key[1], item_count=count,
            first_seen=_EPOCH + timedelta(microseconds=first_us), last_seen=_EPOCH + timedelta(microseconds=last_us),
        )

    def close(self) -> None:
        pass


def quiet_sender_stream(stream: DataFrame, quiet_days: int = 3, delay: str = "0 seconds", forget_days: int = 365) -> DataFrame:
    """A row whenever a sender's last mail lies `quiet_days` behind the watermark.

    `stream`: (tenant_id, email, seen TIMESTAMP). The counts of a sender told of are kept: one who
    writes again and goes quiet again is told of with all mail since the first. A sender silent for
    `forget_days` is forgotten, so the state holds the senders of that time only; one who writes
    after that counts anew. The state is on the executors' disks and in the checkpoint, not in their heaps.
    """
    if forget_days <= quiet_days:
        raise ValueError("senders are forgotten after they were told of")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    partial = (
        stream.select("tenant_id", "email", "seen", F.unix_micros("seen").alias("us"))
        .mapInPandas(_pre_aggregate, _PARTIAL)
        .withWatermark("seen", delay)
    )
    return partial.groupBy("tenant_id", "email").transformWithState(
        QuietSenders(quiet_days, forget_days), OUTPUT, "append", "EventTime"
    )
