"""Daily summaries of facts. A day is a business day at UTC+8 (`cur_date`).

All counts and sums use hash aggregation with partial results before the shuffle, so one hot
organisation, cargo type or day costs no more than any other. Lookups run on aggregated rows wherever
the grouping allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.scalars import local_day
from waybill.operators.lookups import city_province, lookup, lookup_first, org_city

MONEY = "decimal(30,2)"

# Columns of the serving tables in their order; `ts` is the version.
SUMMARY_COLUMNS = {
    "bound_org_sort_day": ["cur_date", "org_id", "org_name", "city_id", "city_name", "province_id", "province_name", "sort_count", "ts"],
    "cargo_type_order_day": ["cur_date", "cargo_type", "cargo_type_name", "order_amount", "order_count", "ts"],
    "org_order_day": ["cur_date", "org_id", "org_name", "city_id", "city_name", "order_amount", "order_count", "ts"],
    "bound_finish_day": ["cur_date", "bound_finish_count", "ts"],
    "dispatch_day": ["cur_date", "dispatch_count", "ts"],
    "org_deliver_suc_day": ["cur_date", "org_id", "org_name", "city_id", "city_name", "province_id", "province_name", "deliver_count", "ts"],
    "org_receive_day": ["cur_date", "org_id", "org_name", "city_id", "city_name", "province_id", "province_name", "receive_count", "ts"],
    "org_truck_model_day": ["cur_date", "org_id", "org_name", "truck_model_id", "truck_model_name", "city_id", "city_name", "finish_count", "finish_distance", "finish_dur_ms", "ts"],
}


def by_day(fact: DataFrame, keys: list[str], **measures: Column) -> DataFrame:
    """Measures per key and business day of `ts`."""
    day = local_day(F.col("ts")).alias("cur_date")
    return fact.groupBy(day, *keys).agg(*[m.alias(n) for n, m in measures.items()])


def fold_first(parts: DataFrame, keys: list[str], first: list[str], measures: dict[str, str]) -> DataFrame:
    """Add up partial groups; attributes in `first` come from the part that was seen first
    (`first_ts`, ties by attribute). `measures` maps a column to its type."""
    attributes = F.min_by(F.struct(*first), F.struct("first_ts", *first)).alias("_first")
    sums = [F.sum(m).cast(kind).alias(m) for m, kind in measures.items()]
    return parts.groupBy("cur_date", *keys).agg(attributes, *sums).select(
        "cur_date", *keys, *[f"_first.{c}" for c in first], *measures)


def bound_org_sort_day(sorts: DataFrame, organ: DataFrame, region: DataFrame) -> DataFrame:
    """Sorted parcels per organisation and day, with city and province of the organisation."""
    counts = by_day(sorts, ["org_id"], sort_count=F.count("*"))
    return city_province(org_city(counts, organ), region).select(SUMMARY_COLUMNS["bound_org_sort_day"][:-1])


def cargo_type_order_day(detail: DataFrame, dic: DataFrame) -> DataFrame:
    """Placed orders and their amount per cargo type and day."""
    sums = by_day(detail, ["cargo_type"], order_amount=F.sum("amount").cast(MONEY), order_count=F.count("*"))
    named = lookup(sums, dic, "cargo_type", {"name": "cargo_type_name"})
    return named.select(SUMMARY_COLUMNS["cargo_type_order_day"][:-1])


def _by_district_org(
    fact: DataFrame, organ: DataFrame, district: str, first: list[str], kinds: dict[str, str], **measures: Column
) -> DataFrame:
    """Measures per organisation and day, the organisation being the first one in the row's district.

    The organisation depends on the district alone, so rows are added up per district before the
    lookup and per organisation after it.
    """
    parts = by_day(fact, [district, *first], first_ts=F.min("ts"), **measures)
    routed = lookup_first(parts, organ, district, "region_id", {"id": "org_id", "org_name": "org_name"})
    return fold_first(routed, ["org_id", "org_name"], first, kinds)


def org_order_day(detail: DataFrame, organ: DataFrame, region: DataFrame) -> DataFrame:
    """Placed orders and their amount per sending organisation and day."""
    fact = detail.withColumn("city_id", F.col("sender_city_id"))
    sums = _by_district_org(
        fact, organ, "sender_district_id", ["city_id"], {"order_amount": MONEY, "order_count": "bigint"},
        order_amount=F.sum("amount"), order_count=F.count("*"))
    return lookup(sums, region, "city_id", {"name": "city_name"}).select(SUMMARY_COLUMNS["org_order_day"][:-1])


def bound_finish_day(fact: DataFrame) -> DataFrame:
    """Finished transfers per day."""
    return by_day(fact, [], bound_finish_count=F.count("*"))


def dispatch_day(fact: DataFrame) -> DataFrame:
    """Dispatched parcels per day."""
    return by_day(fact, [], dispatch_count=F.count("*"))


def _org_side_day(fact: DataFrame, organ: DataFrame, region: DataFrame, side: str, measure: str) -> DataFrame:
    places = fact.withColumns({"city_id": F.col(f"{side}_city_id"), "province_id": F.col(f"{side}_province_id")})
    counts = _by_district_org(
        places, organ, f"{side}_district_id", ["city_id", "province_id"], {measure: "bigint"}, **{measure: F.count("*")})
    cities = lookup(counts, region, "city_id", {"name": "city_name"})
    return lookup(cities, region, "province_id", {"name": "province_name"})


def org_deliver_suc_day(fact: DataFrame, organ: DataFrame, region: DataFrame) -> DataFrame:
    """Delivered parcels per receiving organisation and day."""
    return _org_side_day(fact, organ, region, "receiver", "deliver_count").select(SUMMARY_COLUMNS["org_deliver_suc_day"][:-1])


def org_receive_day(fact: DataFrame, organ: DataFrame, region: DataFrame) -> DataFrame:
    """Received parcels per sending organisation and day."""
    return _org_side_day(fact, organ, region, "sender", "receive_count").select(SUMMARY_COLUMNS["org_receive_day"][:-1])


def org_truck_model_day(
    trips: DataFrame, truck: DataFrame, model: DataFrame, organ: DataFrame, region: DataFrame
) -> DataFrame:
    """Finished trips, their distance and duration per starting organisation, truck model and day.

    A truck makes few trips a day, so its model is looked up before any grouping.
    """
    fact = lookup(
        trips.select("start_org_id", "start_org_name", "truck_id", "actual_distance", "transport_time", "ts"),
        truck, "truck_id", {"truck_model_id": "truck_model_id"})
    parts = by_day(
        fact.withColumnsRenamed({"start_org_id": "org_id", "start_org_name": "org_name"}),
        ["org_id", "truck_model_id", "org_name"], first_ts=F.min("ts"),
        finish_count=F.count("*"), finish_distance=F.sum("actual_distance"), finish_dur_ms=F.sum("transport_time"))
    sums = fold_first(parts, ["org_id", "truck_model_id"], ["org_name"],
                      {"finish_count": "bigint", "finish_distance": MONEY, "finish_dur_ms": "bigint"})
    named = lookup(sums, model, "truck_model_id", {"model_name": "truck_model_name"})
    cities = lookup(org_city(named, organ, name=None), region, "city_id", {"name": "city_name"})
    return cities.select(SUMMARY_COLUMNS["org_truck_model_day"][:-1])
