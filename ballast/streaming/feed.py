"""The change-only history feed as a stateful processor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ballast.session import ship_package
from ballast.streaming import runner

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChangesOnly(StatefulProcessor):
    """Rows of one identity, in the order of time and `seq`, that differ from the row before them.

    State of an identity: the sizes of its last settled row, and the rows the watermark has not
    reached yet. A timer at the oldest waiting row settles all that the watermark has passed, so
    rows may come late and in any order within the watermark's delay.
    """

    def __init__(self, key: str, sizes: list[str], idle_ms: int | None):
        self.key, self.sizes, self.idle_ms = key, sizes, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{size} long" for size in self.sizes)
        self.handle = handle
        self.last = handle.getValueState("last", fields, self.idle_ms)
        # a list, so that rows go to the state and come back by batches and not one by one
        self.waiting = handle.getListState("waiting", f"ts_ms long, seq long, {fields}")
        self.timer = handle.getValueState("timer", "at long")

    def _arm(self, at: int) -> None:
        armed = self.timer.get() if self.timer.exists() else None
        if armed is not None and armed[0] <= at:
            return
        if armed is not None:
            self.handle.deleteTimer(armed[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        landed = []
        for frame in rows:
            frame = frame[~frame[runner.CLOCK].astype(bool)]
            columns = [
                [None if missing else int(v) for v, missing in zip(frame[name], frame[name].isna(), strict=True)]
                for name in ("ts_ms", "seq", *self.sizes)
            ]
            landed.extend(zip(*columns, strict=True))
        if landed:
            self.waiting.appendList(landed)
            self._arm(min(row[0] for row in landed))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        # a row that landed again takes the place of the one before
        waiting = {tuple(row[:2]): tuple(row[2:]) for row in self.waiting.get()}
        settled = [(at, sizes) for at, sizes in waiting.items() if at[0] <= now]
        left = [(*at, *sizes) for at, sizes in waiting.items() if at[0] > now]
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, sizes in sorted(settled):
            if before is None or sizes != before:
                out.append((*key, *at, *sizes))
            before = sizes
        if settled:
            self.last.update(before)
        if left:
            self.waiting.put(left)
            self._arm(min(row[0] for row in left))
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key, "ts_ms", "seq", *self.sizes]).astype({s: "Int64" for s in self.sizes})

    def close(self) -> None:
        pass


def history_feed(items: DataFrame, key: str, sizes: list[str], delay: str = "1 minute", idle_ms: int | None = None) -> DataFrame:
    """T8 on a stream: durable rows (key, ts, ts_ms, seq, sizes, CLOCK) -> change-only rows.

    Rows later than `delay` are dropped, as everywhere behind a watermark. With `idle_ms` the
    last sizes of an identity that stays quiet for so long are forgotten, which bounds the state
    by the identities in use, and its next row counts as its first. The state is kept in RocksDB.
    """
    spark = items.sparkSession
    ship_package(spark)
    spark.conf.set(_PROVIDER, _ROCKS)
    types = dict(items.dtypes)
    schema = f"{key} {types[key]}, ts_ms long, seq long, " + ", ".join(f"{size} long" for size in sizes)
    own = items.withWatermark("ts", delay).select(key, "ts", "ts_ms", "seq", *[F.col(s).cast("long").alias(s) for s in sizes], runner.CLOCK)
    return own.groupBy(key).transformWithStateInPandas(
        ChangesOnly(key, sizes, idle_ms), schema, outputMode="Append", timeMode="EventTime"
    )
