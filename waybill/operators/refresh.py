"""Names in summaries after changes of dimensions: only the rows that show a changed dimension row come again.

The feed of changed keys (`operators.routing.changed_keys`) says which dimension rows changed. A delta join finds the summary rows that show
them, and only their names are looked up anew, so the work grows with the changes and what they touch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators.summaries import SUMMARY_COLUMNS

# Column of a summary -> dimension whose rows it shows.
SHOWS = {
    "bound_org_sort_day": {"org_id": "dim_base_organ", "city_id": "dim_base_region_info", "province_id": "dim_base_region_info"},
    "cargo_type_order_day": {"cargo_type": "dim_base_dic"},
    "org_order_day": {"city_id": "dim_base_region_info"},
    "org_deliver_suc_day": {"city_id": "dim_base_region_info", "province_id": "dim_base_region_info"},
    "org_receive_day": {"city_id": "dim_base_region_info", "province_id": "dim_base_region_info"},
    "org_truck_model_day": {"truck_model_id": "dim_truck_model", "org_id": "dim_base_organ", "city_id": "dim_base_region_info"},
}


def changed_rows(routed: DataFrame) -> DataFrame:
    """(sink_table, id) of the dimension rows that an update changed, from routed events."""
    return routed.where(F.col("changed").isNotNull()).select("sink_table", F.col("row_key").alias("id")).distinct()


def with_children(changed: DataFrame, organ: DataFrame) -> DataFrame:
    """Changed organisations with those below them, whose city is that of their parent; other dimensions as they are."""
    parents = changed.where("sink_table = 'dim_base_organ'").select(F.col("id").alias("org_parent_id"))
    below = organ.join(parents, "org_parent_id", "left_semi").select(F.lit("dim_base_organ").alias("sink_table"), "id")
    return changed.union(below).distinct()


def rows_showing(rows: DataFrame, changed: DataFrame, shows: dict[str, str]) -> DataFrame:
    """Summary rows that show one of the changed dimension rows."""
    hit, out = F.lit(False), rows
    for column, dim in shows.items():
        keys = changed.where(F.col("sink_table") == dim).select(F.col("id").alias(f"_{column}"))
        out = out.join(keys, F.col(column) == F.col(f"_{column}"), "left")
        hit |= F.col(f"_{column}").isNotNull()
    return out.where(hit).drop(*[f"_{c}" for c in shows])


def refreshed(rows: DataFrame, changed: DataFrame, name: str, facts: list[str], names: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """New versions (without `ts`) of the rows of summary `name` that show changed dimension rows.

    `facts` are its columns that do not come from dimensions; `names` looks up the others. `rows` holds one version of each key.
    """
    touched = rows_showing(rows, changed, SHOWS[name]).select("cur_date", *facts)
    return names(touched).select(SUMMARY_COLUMNS[name][:-1])
