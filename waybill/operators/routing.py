"""Dimension branch: route change events by the routing table, project, mask, list changed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from waybill.functions.masks import mask_image
from waybill.functions.scalars import csv_items, non_empty
from waybill.schemas import CONFIG_DIM

# Fixed value: column family used when a routing row names none.
DEFAULT_FAMILY = "info"
# Versions of routing rows: when and where in the log they came, and what they say (nothing, where `op` is a delete).
ROUTING = StructType([
    StructField("source_table", StringType()), StructField("ts", LongType()), StructField("place", StringType()), StructField("op", StringType()),
    *[f for f in CONFIG_DIM.fields if f.name != "source_table"]])
# Most routing rows that are sent to every task.
MAX_ROUTES = 1_000


def latest_by_key(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The newest row of each key. Aggregation starts before the shuffle, so many versions of one
    key shrink to one row per task first."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_newest"))
    return newest.select(*keys, "_newest.*").select(*df.columns)


def config_latest(changes: DataFrame, preloaded: DataFrame | None = None) -> DataFrame:
    """Routing rows now in force from their change log (op, before, after, ts).

    Creates, reads and updates add or replace the row of a source table, deletes remove it. Rows
    loaded beforehand count as older than every change.
    """
    versions = changes.select(
        F.coalesce("after.source_table", "before.source_table").alias("source_table"), "op", "ts", "after")
    if preloaded is not None:
        fields = changes.schema["after"].dataType.names
        loaded = preloaded.select(
            "source_table", F.lit("r").alias("op"), F.lit(None).cast("long").alias("ts"), F.struct(*fields).alias("after"))
        versions = versions.unionByName(loaded)
    return latest_by_key(versions, ["source_table"], ["ts", "op"]).where("op <> 'd'").select("after.*")


def routing_versions(changes: DataFrame) -> DataFrame:
    """Versions of routing rows by their place in the log (see ROUTING), from their changes (op, before, after, ts, place)."""
    row = [F.col(f"after.{f}").alias(f) for f in CONFIG_DIM.names if f != "source_table"]
    return changes.select(F.coalesce("after.source_table", "before.source_table").alias("source_table"), F.col("ts").cast("long").alias("ts"), "place", "op", *row)


def loaded_versions(loaded: DataFrame) -> DataFrame:
    """Routing rows of a bounded scan as versions older than every change."""
    return loaded.select("source_table", F.lit(None).cast("long").alias("ts"), F.lit("").alias("place"), F.lit("r").alias("op"), *ROUTING.names[4:])


def keep_columns(image: Column, names: Column) -> Column:
    """The entries of a column -> value map whose names are listed (`csv_items` of a routing row)."""
    return F.map_filter(image, lambda name, _: F.array_contains(names, name))


def changed_keys(op: Column, before: Column, foreign_keys: Column) -> Column:
    """On update: (name, old value) of `id` and of every foreign key; null otherwise."""
    names = F.array_prepend(csv_items(foreign_keys), F.lit("id"))
    pairs = F.transform(names, lambda name: F.struct(name.alias("name"), before[name].alias("value")))
    return F.when(op == "u", pairs)


def _broadcast_if_small(config: DataFrame) -> DataFrame:
    """Routing rows number as many as there are dimension tables. A join by shuffle on the few table
    names would gather whole tables in one task, so the rows are broadcast once counted as few."""
    return F.broadcast(config) if config.limit(MAX_ROUTES + 1).count() <= MAX_ROUTES else config


def route_dims(events: DataFrame, config: DataFrame) -> DataFrame:
    """Events (table, op, before, after, ts) of the configured tables, ready to be stored.

    Result: sink_table, sink_pk, sink_family, row_key, columns (masked column -> text value map
    without helper entries), changed (see `changed_keys`), ts, place. Masking runs before the projection.
    """
    return _routed(events, config, F.col("table") == F.col("source_table"))


def route_dims_as_of(events: DataFrame, versions: DataFrame) -> DataFrame:
    """`route_dims` by the routing that was in force at each event's place in the log: the newest version (see ROUTING) at or before it.

    Events before the first version of their table, or after its removal, do not pass. A version holds until the next one of its table, so the join is
    an equi-join on the table with a range on the place; the result depends on the log alone, not on when routing rows or events are read.
    Of several versions at one place the last operation counts.
    """
    # Rows loaded beforehand have no time: they are older than all others.
    at = F.struct(F.coalesce("_ts", F.lit(-(2 ** 63))).alias("ts"), F.col("_place").alias("place"))
    one = latest_by_key(versions, ["source_table", "ts", "place"], ["op"]).withColumnsRenamed({"ts": "_ts", "place": "_place", "op": "_op"})
    until = F.lead(at).over(Window.partitionBy("source_table").orderBy(at))
    spans = one.withColumn("_until", until).where("_op <> 'd'")
    place = F.struct("ts", F.col("place") if "place" in events.columns else F.lit("").alias("place"))
    here = (F.col("table") == F.col("source_table")) & (at <= place) & (F.col("_until").isNull() | (place < F.col("_until")))
    return _routed(events, spans, here)


def _routed(events: DataFrame, config: DataFrame, here: Column) -> DataFrame:
    # Lists are split once per routing row, not once per map entry.
    routes = _broadcast_if_small(config).withColumn("_names", csv_items(F.col("sink_columns")))
    image = keep_columns(mask_image(F.col("table"), F.col("after")), F.col("_names"))
    return (
        events.join(routes, here)
        .select(
            "sink_table", "sink_pk", F.coalesce(non_empty(F.col("sink_family")), F.lit(DEFAULT_FAMILY)).alias("sink_family"),
            F.element_at("after", F.col("sink_pk")).alias("row_key"), image.alias("columns"),
            changed_keys(F.col("op"), F.col("before"), F.col("foreign_keys")).alias("changed"), "ts",
            F.col("place") if "place" in events.columns else F.lit("").alias("place"))
    )


def dim_rows(routed: DataFrame, sink_table: str, columns: list[str]) -> DataFrame:
    """Routed events of one dimension as flat text columns plus `seq`."""
    flat = [F.element_at("columns", F.lit(c)).alias(c) for c in columns]
    return routed.where(F.col("sink_table") == sink_table).select(*flat, F.col("ts").alias("seq"))
