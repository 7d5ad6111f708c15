"""The running series of a summary, fired by event time: the cumulative value of a key and day at each 10-second boundary that changed it.

Rows are added up per slot inside the tasks first, so a hot key sends few rows. The state of a key and day is one value: its total and the sums of its
open slots, in lists, so that a micro-batch reads and writes it once, however many slots it touches. One timer stands at the end of the earliest open slot. When the
watermark passes it, all slots up to the watermark go into the total one after the other and the totals go out, each versioned by its boundary; the
boundary that ends the day is the last, and the state goes with it. What is emitted depends on event times alone, not on micro-batches or clocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waybill.functions.scalars import local_day
from waybill.streaming.events import with_event_time

# Fixed value: length of a slot.
SLOT_MS = 10_000
DAY_MS = 86_400_000


class SlotTotals(StatefulProcessor):
    """Cumulative totals of one key and day; the key's last field is the end of the day."""

    def __init__(self, keys: list[str], measures: list[str], kinds: list[str], slot_ms: int) -> None:
        self.keys, self.measures, self.kinds, self.slot_ms = keys, measures, kinds, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lists = [f"`open{i}` array<{kind}>" for i, kind in enumerate(self.kinds)]
        totals = [f"`total{i}` {kind}" for i, kind in enumerate(self.kinds)]
        self.state = handle.getValueState("slots", ", ".join(["`slots` array<bigint>", *lists, *totals]))

    def _read(self) -> tuple[dict[int, tuple], tuple | None]:
        """Sums of the open slots, and the total so far (None: no slot was emitted)."""
        if not self.state.exists():
            return {}, None
        slots, *values = self.state.get()
        n = len(self.measures)
        total = tuple(values[n:])
        return dict(zip(slots, zip(*values[:n]))), None if total[0] is None else total

    def _write(self, held: dict[int, tuple], total: tuple | None) -> None:
        n = len(self.measures)
        self.state.update((list(held), *[[sums[i] for sums in held.values()] for i in range(n)], *(total or [None] * n)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, end = timerValues.getCurrentWatermarkInMs(), int(key[-1])
        parts = pd.concat(list(rows), ignore_index=True)
        if now < end:
            # A late row of an open day counts from the next boundary on; those of a closed day are dropped.
            parts["slot"] = parts["slot"].clip(lower=(now // self.slot_ms + 1) * self.slot_ms)
            held, total = self._read()
            first = min(held, default=None)
            sums = parts.groupby("slot")[self.measures].sum()
            for slot, *values in sums.itertuples(name=None):
                held[int(slot)] = _added(held.get(int(slot)), tuple(values))
            if first is None or min(held) < first:
                self.handle.registerTimer(min(held))
                if first is not None:
                    self.handle.deleteTimer(first)
            self._write(held, total)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, upto = int(key[-1]), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held, total = self._read()
        out = []
        for slot in sorted(s for s in held if s <= upto):
            total = _added(total, held.pop(slot))
            out.append((*key, slot, *total))
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "day_end", "slot", *self.measures])
        if held:
            self.handle.registerTimer(min(held))
        elif upto < end and total is not None:
            # The state goes at the end of the day, whether rows came in its last slot or not.
            self.handle.registerTimer(end)
        if held or upto < end:
            self._write(held, total)
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def _added(one: tuple | None, two: tuple) -> tuple:
    plain = lambda v: v.item() if hasattr(v, "item") else v
    return tuple(plain(b) if one is None else plain(a + b) for a, b in zip(one or two, two))


def _per_slot(batches: Iterator[pd.DataFrame], keys: list[str], measures: list[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.groupby([*keys, "day_end", "slot"], dropna=False, as_index=False, sort=False)[measures].sum()


def event_series(
    df: DataFrame, keys: list[str], measures: dict[str, str], ts: str = "ts", delay: str = "0 seconds", slot_ms: int = SLOT_MS
) -> DataFrame:
    """keys, cur_date, version and the measures so far, for a stream; `measures` names the column to add up, or `1` to count.

    The stream of `operators.snapshots.cumulative_snapshots`, row by row. Rows with a null time are left out. What comes after `delay` behind the newest
    row counts from the next boundary on, unless its day is over. A slot goes out when the watermark passes its end, so
    the last ones wait for later rows of any key.
    """
    timed = with_event_time(df, ts, delay)
    ms = F.unix_millis(F.col(ts))
    day_end = (F.floor((ms + 8 * 3_600_000) / DAY_MS) + 1) * DAY_MS - 8 * 3_600_000
    # Without the time column itself: rows of an open day are not late, however old they are.
    rows = timed.where(F.col(ts).isNotNull()).select(
        *keys, day_end.cast("long").alias("day_end"), ((F.floor(ms / slot_ms) + 1) * slot_ms).cast("long").alias("slot"),
        *[(F.lit(1).cast("long") if c == "1" else F.col(c)).alias(n) for n, c in measures.items()])
    kinds = [rows.schema[n].dataType.simpleString() for n in measures]
    summed = rows.mapInPandas(partial(_per_slot, keys=keys, measures=list(measures)), rows.schema)
    states = summed.groupBy(*keys, "day_end").transformWithStateInPandas(
        SlotTotals(keys, list(measures), kinds, slot_ms), outputStructType=rows.schema, outputMode="append", timeMode="EventTime")
    start = F.timestamp_millis(F.col("day_end") - DAY_MS)
    return states.select(*keys, local_day(start).alias("cur_date"), F.timestamp_millis("slot").alias("version"), *measures)
