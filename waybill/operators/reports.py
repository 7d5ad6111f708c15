"""Reports over versioned summaries (`ts` is the version)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions.scalars import day_of_report_date, local_day
from waybill.operators.snapshots import latest_snapshot
from waybill.operators.summaries import MONEY

_ORG_KEYS = ["cur_date", "org_id", "org_name", "city_id", "city_name"]
# Fixed value: label of the sorting report.
SORT_LABEL = "分拣"


def on_day(df: DataFrame, date: str | None) -> DataFrame:
    """Rows of one day, the current business day (UTC+8) by default. The filter is on the stored date, so it reaches the scan."""
    day = F.lit(day_of_report_date(date)).cast("date") if date else local_day(F.current_timestamp())
    return df.where(F.col("cur_date") == day)


def order_amount_by_day(summary: DataFrame, version: str = "ts") -> DataFrame:
    """Total amount of placed orders for every day. Keys the summary lacks (names, before they are looked up) are left out."""
    newest = latest_snapshot(summary, _own(summary, _ORG_KEYS), ["order_amount"], version)
    return newest.groupBy("cur_date").agg(F.sum("order_amount").cast(MONEY).alias("order_amount"))


def order_amount(summary: DataFrame, date: str | None = None, version: str = "ts") -> DataFrame:
    """Total amount of one day: a single row, null on a day without orders."""
    newest = latest_snapshot(on_day(summary, date), _own(summary, _ORG_KEYS), ["order_amount"], version)
    return newest.agg(F.sum("order_amount").cast(MONEY).alias("order_amount"))


def _own(df: DataFrame, keys: list[str]) -> list[str]:
    return [k for k in keys if k in df.columns]


def sort_count_by_province(
    summary: DataFrame, date: str | None = None, version: str = "ts", every_day: bool = False,
    names: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Sorted parcels per province on one day, or for every day of the summary.

    `names` looks up what the summary lacks; it sees one row per organisation and day.
    """
    rows = summary if every_day else on_day(summary, date)
    newest = names(latest_snapshot(rows, _own(summary, [*_ORG_KEYS, "province_id", "province_name"]), ["sort_count"], version))
    groups = ["cur_date", "province_name"] if every_day else ["province_name"]
    return newest.groupBy(*groups).agg(F.sum("sort_count").alias("value"))


def map_payload(report: DataFrame, label: str = SORT_LABEL, by: list[str] | None = None) -> DataFrame:
    """Report rows (province_name, value) as one list of {name, value} with a label.

    The list has one entry per province, never one per fact.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col("province_name").alias("name"), "value")))
    grouped = report.groupBy(*(by or []))
    return grouped.agg(pairs.alias("map_data")).withColumn("value_name", F.lit(label))
