"""Facts: status changes of waybills, warehouse steps and finished trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions import scalars as S
from waybill.functions.masks import mask_order_names, mask_trip

# Status transition -> fact. Any other transition to CANCELLED is a cancel.
TRANSITIONS = {
    ("60010", "60020"): "pay_suc",
    ("60020", "60030"): "receive",
    ("60040", "60050"): "dispatch",
    ("60050", "60060"): "bound_finish",
    ("60060", "60070"): "deliver",
    ("60070", "60080"): "sign",
}
CANCELLED = "60999"

# Fact -> name of its time column. Placement takes the time of the cargo row, the
# others the update time of the order row.
TIME_COLUMNS = {
    "detail": "order_time", "pay_suc": "pay_time", "cancel": "cancel_time", "receive": "receive_time",
    "dispatch": "dispatch_time", "bound_finish": "bound_finish_time", "deliver": "deliver_time", "sign": "sign_time",
}

# Sink name of each fact; a deployment may put a prefix before them.
TOPICS = {
    "detail": "dwd_trade_order_detail", "pay_suc": "dwd_trade_pay_suc_detail",
    "cancel": "dwd_trade_cancel_detail", "receive": "dwd_trans_receive_detail",
    "dispatch": "dwd_trans_dispatch_detail", "bound_finish": "dwd_trans_bound_finish_detail",
    "deliver": "dwd_trans_deliver_detail", "sign": "dwd_trans_sign_detail",
    "inbound": "dwd_bound_inbound", "sort": "dwd_bound_sort", "outbound": "dwd_bound_outbound",
    "trip_finish": "dwd_trans_trans_finish",
}

# Cargo and order columns of the detail row, by their names on the wire.
CARGO_COLUMNS = {
    "id": "id", "order_id": "order_id", "cargo_type": "cargo_type", "volumn_length": "volume_length",
    "volumn_width": "volume_width", "volumn_height": "volume_height", "weight": "weight",
}
ORDER_COLUMNS = [
    "order_no", "status", "collect_type", "user_id", "receiver_complex_id", "receiver_province_id", "receiver_city_id",
    "receiver_district_id", "receiver_name", "sender_complex_id", "sender_province_id", "sender_city_id",
    "sender_district_id", "sender_name", "payment_type", "cargo_num", "amount", "estimate_arrive_time", "distance",
]


def became_set(column: str) -> Column:
    """An update that gives a column its first value."""
    return (
        (F.col("op") == "u") & F.col("before").isNotNull()
        & F.col(f"before.{column}").isNull() & F.col(f"after.{column}").isNotNull()
    )


def status_fact(before: Column, after: Column) -> Column:
    """Name of the fact a status change stands for, null for transitions nobody reports."""
    out = None
    for (old, new), fact in TRANSITIONS.items():
        out = (F.when if out is None else out.when)((before == old) & (after == new), F.lit(fact))
    return out.when(after == CANCELLED, F.lit("cancel"))


def waybill_detail(joined: DataFrame, fact: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Wide waybill rows of joined (fact, cargo, order) rows; names are masked.

    With a fact name only its rows are taken and the time column gets that fact's name; without one
    all facts are kept with a `fact` column and the time as `fact_time`. `columns` limits the cargo
    and order columns (for rows joined from `order_join.narrow_images`).
    """
    rows = joined if fact is None else joined.where(F.col("fact") == fact)
    time = F.when(F.col("fact") == "detail", F.col("cargo.create_time")).otherwise(F.col("order.update_time"))
    wide = rows.select(
        *(["fact"] if fact is None else []),
        *[F.col(f"cargo.{c}").alias(name) for c, name in CARGO_COLUMNS.items() if columns is None or name in columns],
        time.alias("fact_time" if fact is None else TIME_COLUMNS[fact]),
        *[F.col(f"order.{c}").alias(c) for c in ORDER_COLUMNS if columns is None or c in columns],
        time.alias("ts"))
    return mask_order_names(wide)


def order_status_facts(joined: DataFrame) -> dict[str, DataFrame]:
    """One wide table per fact from the joined rows."""
    return {fact: waybill_detail(joined, fact) for fact in TIME_COLUMNS}


# Warehouse step -> columns of its time and of the employee.
BOUND_STEPS = {
    "inbound": ("inbound_time", "inbound_emp_id"),
    "sort": ("sort_time", "sorter_emp_id"),
    "outbound": ("outbound_time", "outbound_emp_id"),
}


def _bound_happens(step: str) -> Column:
    return F.col("op") == "c" if step == "inbound" else became_set(BOUND_STEPS[step][0])


def narrow_bounds(changes: DataFrame) -> DataFrame:
    """Warehouse changes with the fields alone that the steps read: of the image before, whether a time was set."""
    times = [time for time, _ in BOUND_STEPS.values()]
    fields = ["id", "order_id", "org_id", *[c for names in BOUND_STEPS.values() for c in names]]
    old = F.struct(*[F.col(f"before.{c}").alias(c) for c in times if c != "inbound_time"])
    return changes.select(
        "op", F.when(F.col("before").isNotNull(), old).alias("before"),
        F.when(F.col("after").isNotNull(), F.struct(*[F.col(f"after.{c}").alias(c) for c in fields])).alias("after"))


def bound_facts(changes: DataFrame) -> dict[str, DataFrame]:
    """Warehouse events split into inbound (create), sort and outbound (first time set by an update)."""

    def fact(step: str) -> DataFrame:
        time, emp = BOUND_STEPS[step]
        at = S.instant_of_wall_millis(F.col(f"after.{time}"))
        return changes.where(_bound_happens(step)).select(
            "after.id", "after.order_id", "after.org_id", at.alias(time), f"after.{emp}", at.alias("ts"))

    return {step: fact(step) for step in BOUND_STEPS}


def bound_steps(changes: DataFrame) -> DataFrame:
    """All warehouse facts in one pass, one row per step an event stands for (an update can be two):
    fact, id, order_id, org_id, emp_id, ts."""
    steps = F.array_compact(F.array(*[F.when(_bound_happens(step), F.lit(step)) for step in BOUND_STEPS]))
    rows = changes.select("after", F.explode(steps).alias("fact"))

    def of_step(column: int) -> Column:
        out = None
        for step, names in BOUND_STEPS.items():
            out = (F.when if out is None else out.when)(F.col("fact") == step, F.col(f"after.{names[column]}"))
        return out

    return rows.select(
        "fact", "after.id", "after.order_id", "after.org_id", of_step(1).alias("emp_id"),
        S.instant_of_wall_millis(of_step(0)).alias("ts"))


def trip_finish(changes: DataFrame) -> DataFrame:
    """Finished trips: masked, with their duration in ms and the end as event time."""
    trips = changes.where(became_set("actual_end_time")).select("after.*")
    start, end = (S.instant_of_wall_millis(F.col(c)) for c in ("actual_start_time", "actual_end_time"))
    return mask_trip(trips).withColumns({
        "transport_time": S.millis(end) - S.millis(start),
        "ts": end,
        "actual_start_time": start,
        "actual_end_time": end,
    })
