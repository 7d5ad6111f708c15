"""Running totals fired by event time, and streams in any order and batching."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from waybill.operators import snapshots
from waybill.plans.streams import as_stream, end_marker, finish
from waybill.session import shared_dir
from waybill.streaming.series import SlotTotals, event_series

DAY = datetime(2024, 1, 1, 15, 59, tzinfo=timezone.utc)


def table(spark, rows):
    return spark.createDataFrame([(k, DAY + timedelta(milliseconds=ms), Decimal(v)) for k, ms, v in rows], "k string, ts timestamp, v decimal(10,2)")


def emitted(spark, stream, delay="0 seconds"):
    root = shared_dir(spark, "test-series")
    series = event_series(stream, ["k"], {"n": "1", "v": "v"}, delay=delay)
    finish(series.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    return sorted((tuple(r) for r in spark.read.schema(series.schema).parquet(f"{root}/out").collect()), key=str)


def expected(df):
    series = snapshots.cumulative_snapshots(df, ["k"], {"n": F.count("*"), "v": F.sum("v")})
    return sorted((tuple(r) for r in series.select("k", "cur_date", "version", "n", "v").collect()), key=str)


def random_rows(seed, n=150):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "b", None]), r.randrange(150_000), r.randrange(9)) for _ in range(n)]


@pytest.mark.parametrize("slices", [1, 5])
def test_series_equals_the_batch_series_in_any_batching(spark, slices):
    """Over the end of a business day (16:00 UTC), null keys, versions included."""
    df = table(spark, random_rows(slices))
    assert emitted(spark, as_stream(spark, df, "s", slices=slices, late=end_marker(df, k="end"))) == expected(df)


def test_rows_out_of_order_within_the_delay(spark):
    df = table(spark, random_rows(3))
    turned = as_stream(spark, df, "s", slices=6, late=end_marker(df, k="end"), order=lambda n: [1, 0, 3, 2, 5, 4])
    assert emitted(spark, turned, "90 seconds") == expected(df)


def test_late_rows_of_an_open_day_count_from_the_next_boundary(spark):
    """Versions, in seconds after 15:59: the late row of second 1 comes when the watermark is at 25, so it counts from 30 on; the day over drops rows."""
    batches = [[("a", 1_000, 1)], [("a", 25_000, 10)], [("a", 2_000, 100)], [("a", 27_000, 1000)], [("a", 70_000, 1)], [("z", 75_000, 0)], [("a", 3_000, 5000)], [("z", 200_000, 0)], [("z", 200_001, 0)]]
    root = shared_dir(spark, "test-late-series")
    for part in batches:
        table(spark, part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("k string, ts timestamp, v decimal(10,2)").parquet(f"{root}/in")
        series = event_series(stream, ["k"], {"n": "1", "v": "v"})
        finish(series.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    rows = spark.read.schema(series.schema).parquet(f"{root}/out").where("k = 'a'").collect()
    assert sorted((int((r.version.replace(tzinfo=timezone.utc) - DAY).total_seconds()), r.n, int(r.v)) for r in rows) == [(10, 1, 1), (30, 4, 1111), (80, 1, 1)]


class OneKey:
    """State and timers of one key, with the number of calls to them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def _called(self, result=None):
        self.calls += 1
        return result

    def exists(self):
        return self._called(self.value is not None)

    def get(self):
        return self._called(self.value)

    def update(self, value):
        self.value = self._called(value)

    def clear(self):
        self.value = self._called()

    def registerTimer(self, at):
        self._called(self.timers.add(at))

    def deleteTimer(self, at):
        self._called(self.timers.discard(at))


@pytest.mark.parametrize("slots", [5, 3_000])
def test_calls_to_the_state_do_not_grow_with_the_slots(slots):
    """A day of slots comes in two micro-batches, the earlier half last, then the watermark passes half of them and then all."""
    key, processor = OneKey(), SlotTotals(["k"], ["n"], ["bigint"], 10_000)
    processor.init(key)
    at = lambda watermark: SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
    for part in (range(slots // 2, slots), range(slots // 2)):
        rows = pd.DataFrame({"slot": [10_000 * (n + 1) for n in part], "n": 1})
        assert list(processor.handleInputRows(("a", 86_400_000), iter([rows]), at(0))) == []
    assert key.timers == {10_000}
    out = []
    for watermark in (10_000 * (slots // 2), 86_400_000):
        for timer in sorted(t for t in key.timers if t <= watermark):
            key.timers.discard(timer)
            out += processor.handleExpiredTimer(("a", 86_400_000), at(watermark), SimpleNamespace(getExpiryTimeInMs=lambda t=timer: t))
    rows = pd.concat(out)
    assert rows[["slot", "n"]].values.tolist() == [[10_000 * (n + 1), n + 1] for n in range(slots)]
    assert key.value is None and key.calls <= 20
