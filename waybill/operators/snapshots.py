"""Versioned snapshots of summaries: the running series and the newest value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.scalars import local_day

# Fixed value: refresh interval of a running summary, in event time.
SLOT = "10 seconds"


def slot_end(instant: Column, slot: str = SLOT) -> Column:
    """End of the fixed-length slot an instant lies in."""
    return F.window(instant, slot)["end"]


def cumulative_snapshots(
    df: DataFrame, keys: list[str], measures: dict[str, Column], slot: str = SLOT, ts: str = "ts"
) -> DataFrame:
    """Running totals per key and day: one row per slot that changed them, versioned by the slot's end.

    Rows are added up per slot first. A day has a fixed number of slots, so the window that follows
    never sees more rows per key and day than that.
    """
    slots = df.groupBy(*keys, local_day(F.col(ts)).alias("cur_date"), slot_end(F.col(ts), slot).alias("version")).agg(
        *[m.alias(n) for n, m in measures.items()])
    running = Window.partitionBy(*keys, "cur_date").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    totals = [F.sum(n).over(running).alias(n) for n in measures]
    return slots.select(*keys, "cur_date", "version", *totals)


def latest_snapshot(df: DataFrame, keys: list[str], values: list[str], version: str = "version") -> DataFrame:
    """The values of the greatest version of each key."""
    return df.groupBy(*keys).agg(*[F.max_by(v, version).alias(v) for v in values])


def stamp(df: DataFrame, column: str = "ts") -> DataFrame:
    """Emission time as the version."""
    return df.withColumn(column, F.current_timestamp())
