"""Event time, day windows and running summaries of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waybill.functions.scalars import local_day
from waybill.operators.routing import latest_by_key
from waybill.operators.snapshots import SLOT, stamp
from waybill.sources.tables import write_summary


def with_event_time(df: DataFrame, column: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Event time of a stream. Rows older than the newest one by more than `delay` are late: those of
    a closed day are dropped."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def day_window(column: str = "ts") -> Column:
    """One-day windows that start at midnight UTC+8 (16:00 UTC)."""
    return F.window(column, "1 day", "1 day", "16 hours")


def running_summary(
    df: DataFrame, keys: list[str], measures: dict[str, Column], ts: str = "ts", delay: str = "0 seconds"
) -> DataFrame:
    """Totals so far per key and business day; run in update mode, a trigger emits the changed ones."""
    day = day_window(ts).alias("_day")
    totals = with_event_time(df, ts, delay).groupBy(day, *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return totals.select(local_day(F.col("_day.start")).alias("cur_date"), *keys, *measures)


def start_summary(
    totals: DataFrame, target: str, columns: list[str], checkpoint: str, finish=None, trigger: dict | None = None,
    fmt: str = "parquet", **options: str,
) -> StreamingQuery:
    """Append every change of a running summary to its serving table, stamped with the emission time.

    `finish` adds the looked-up columns to the few changed rows of a micro-batch.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        rows = stamp(finish(batch) if finish else batch)
        write_summary(rows, target, columns, fmt, batch_id, **options)

    writer = totals.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": SLOT})).start()


def newest(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Newest emitted row per key and day."""
    order = ["ts"] + (["batch_id"] if "batch_id" in snapshots.columns else [])
    return latest_by_key(snapshots, ["cur_date", *keys], order).drop(*order)
