"""Order rows meet the cargo row of the same waybill: the rules of `operators.order_join` with state, for rows in any order.

Waybills are dealt by a hash of their number into parts, and a part is what has state: a micro-batch costs a part a few calls to its state, however many
waybills and rows of it come. A part's rows wait in a reorder buffer until the watermark passes the end of their bucket of event time; a timer stands at the
end of the earliest one. When it fires, all rows that are due by then are put in order, waybill by waybill, and meet the rules, and a timer is set for the earliest of the
rest. The watermark's delay says how far out of order rows may be; those that come later than that are
taken when they come. Times are those of the events, so a replay in other micro-batches gives the same facts.

Per waybill the state keeps the rows that wait, the held cargo and the waiting order. Images go through as text that nothing in between reads, and only
with the fields that `narrow_images` left. The held cargo goes with the cancel or the signing, the waiting order once its time is over.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waybill.operators.order_join import CLEARING_FACTS, relevant

# A row as a part keeps it: the waybill, what puts its rows in order, and what the rules read.
_FIELDS = ["order_id", "ms", "place", "tbl", "op", "status", "cargo_id", "step", "image"]
_MS = _FIELDS.index("ms")
_NOTHING = (None, None, None)
_OUT = ["fact", "cargo", "order"]
_IMAGE_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

# Length of a bucket of the reorder buffer.
BUCKET_MS = 60_000
# Parts of the waybills. A part's rows of a micro-batch and what it keeps of its open waybills are in one task's memory; a checkpoint keeps its number.
PARTS = 1024


class OrderJoin(StatefulProcessor):
    """Facts of one part of the waybills from their order and cargo rows."""

    def __init__(self, ttl_ms: int, clear_on: tuple[str, ...], bucket_ms: int) -> None:
        self.ttl_ms, self.clear_on, self.bucket_ms = ttl_ms, clear_on, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Held cargo, waiting order and since when it waits, by waybill.
        self.kept = handle.getValueState("kept", "waybills binary")
        # Rows as they came, many in one value.
        self.buffer = handle.getListState("buffer", "rows binary")

    def due(self, ms: int) -> int:
        return (int(ms) // self.bucket_ms + 1) * self.bucket_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            columns = [part[c].tolist() for c in _FIELDS]
            self.buffer.appendValue((pickle.dumps(list(zip(*columns))),))
            first = min(columns[_MS]) if first is None else min(first, *columns[_MS])
        if first is not None:
            self.handle.registerTimer(self.due(first))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        rows, rest = [], []
        for (held,) in self.buffer.get():
            for r in pickle.loads(held):
                due = self.due(r[_MS])
                (rows if due <= at or due < now else rest).append(r)
        if not rows:
            return
        if rest:
            self.buffer.put([(pickle.dumps(rest),)])
            self.handle.registerTimer(self.due(min(r[_MS] for r in rest)))
        else:
            self.buffer.clear()
        kept = pickle.loads(self.kept.get()[0]) if self.kept.exists() else {}
        facts, changed = [], False
        for waybill, of_waybill in groupby(sorted(rows), lambda r: r[0]):
            before = kept.get(waybill, _NOTHING)
            after = self.in_order(of_waybill, before, facts)
            if after == before:
                continue
            changed = True
            if after == _NOTHING:
                del kept[waybill]
            else:
                kept[waybill] = after
        if changed and kept:
            self.kept.update((pickle.dumps(kept),))
        elif changed:
            self.kept.clear()
        if facts:
            yield pd.DataFrame(facts, columns=_OUT)

    def in_order(self, rows: Iterator[tuple], kept: tuple, facts: list[tuple]) -> tuple:
        """Add the facts of a waybill's rows; what is kept after them: held cargo, waiting order and since when it waits."""
        cargo, waiting, since = kept
        for _, ms, _, tbl, op, _, _, step, image in rows:
            if waiting and ms - since >= self.ttl_ms:
                waiting = since = None
            if tbl == "order_cargo":
                cargo = image
                if waiting:
                    facts.append(("detail", cargo, waiting))
            elif op == "c" and cargo:
                facts.append(("detail", cargo, image))
            elif op == "c":
                waiting, since = image, ms
            elif step and cargo:
                facts.append((step, cargo, image))
                cargo = None if step in self.clear_on else cargo
        return cargo, waiting, since

    def close(self) -> None:
        pass


def join_orders(
    changes: DataFrame, ttl_seconds: float = 5, clear_on: tuple[str, ...] = CLEARING_FACTS, delay: str = "0 seconds", bucket_ms: int = BUCKET_MS,
    parts: int = PARTS,
) -> DataFrame:
    """(fact, cargo, order) rows of a stream of typed changes; needs the RocksDB state provider.

    `delay` is how far behind the newest row others may come. Facts go out when the watermark passes their bucket, so the last ones wait for a later row, which
    may be one without order_id.
    """
    kinds = {c: changes.schema[c].dataType for c in ("cargo", "order")}
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    text = lambda c: F.coalesce(c, F.lit(""))
    place = text(F.col("place")) if "place" in changes.columns else F.lit("")
    # Rows without order_id move the watermark, so they must not be filtered before it: the test names the time, too.
    timed = timed.withColumn("order_id", F.when(F.col("ts").isNotNull(), F.col("order_id")))
    # Without the time column itself: rows behind the watermark are not dropped. Rows are put in order as they are, so nulls are empty texts, which come first.
    rows = relevant(timed).select(
        F.pmod(F.xxhash64("order_id"), F.lit(parts)).alias("part"), "order_id", F.unix_millis("ts").alias("ms"), place.alias("place"), "tbl",
        *[text(F.col(c)).alias(name) for c, name in {"op": "op", "order.status": "status", "cargo.id": "cargo_id", "_status": "step"}.items()],
        F.coalesce(*[F.to_json(c, _IMAGE_TIME) for c in kinds]).alias("image"))
    joined = rows.groupBy("part").transformWithStateInPandas(
        OrderJoin(int(ttl_seconds * 1000), clear_on, bucket_ms), outputStructType="fact string, cargo string, `order` string", outputMode="append", timeMode="EventTime")
    return joined.select("fact", *[F.from_json(c, kind, _IMAGE_TIME).alias(c) for c, kind in kinds.items()])
