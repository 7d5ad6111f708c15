"""Named queries: each takes (spark, sf_dir) and returns a DataFrame over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill import schemas
from waybill.functions import masks
from waybill.functions import scalars as S
from waybill.operators import facts, lookups, refresh, reports, routing, snapshots, summaries
from waybill.operators.order_join import join_orders_batch, narrow_images, wanted_fields
from waybill.plans import standins, streams
from waybill.plans.wire import as_wire
from waybill.session import prepare, shared_dir
from waybill.sources import changes, files, tables, topics
from waybill.sources.versions import VersionedTable
from waybill.streaming import dims

Query = Callable[[SparkSession, str], DataFrame]

# A day within the data for the one-day reports; `*_by_day` queries report every day.
REPORT_DATE = "19970528"


# ---------------------------------------------------------------- shared inputs

def joined_orders(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, fact: str | None = None) -> DataFrame:
    log = standins.order_changes(spark, sf_dir)
    if columns is not None:
        log = narrow_images(log, columns)
    return join_orders_batch(log, fact=fact)


def fact_rows(spark: SparkSession, sf_dir: str, fact: str, columns: list[str] | None = None) -> DataFrame:
    return facts.waybill_detail(joined_orders(spark, sf_dir, columns, fact), fact, columns)


def sort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.bound_facts(standins.bound_changes(spark, sf_dir))["sort"]


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.trip_finish(standins.trip_changes(spark, sf_dir))


def org_dims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return standins.base_organ(spark, sf_dir), standins.base_region_info(spark, sf_dir)


def _cells(df: DataFrame, image: str, *keys: str) -> DataFrame:
    """A column -> value map as one row per cell."""
    return df.select(*keys, F.explode(image).alias("name", "value"))


# ---------------------------------------------------------------- change log

def live_changes(spark, sf_dir):
    # Only the wanted field of the images is in the schema, so the parser skips the others.
    image = T.StructType([T.StructField("id", T.StringType())])
    events = changes.live_changes(changes.parse_envelope(standins.order_log(spark, sf_dir), image))
    return events.select(F.col("source.table").alias("source_table"), "op", "after.id", "ts")


def table_filter(spark, sf_dir):
    raw = changes.of_tables(standins.order_log(spark, sf_dir), ["order_cargo"])
    events = changes.live_changes(changes.parse_envelope(raw, schemas.ORDER_CARGO))
    return changes.normalize(events, ("source", "ts")).select("table", "op", "after.order_id", "after.cargo_type")


def envelope_fields(spark, sf_dir):
    fields = {"order": {"status", "amount", "estimate_arrive_time"}, "cargo": {"weight", "create_time"}}
    return changes.order_changes(standins.order_log(spark, sf_dir), fields).select(
        "order_id", "tbl", "op", "ts", "before_status", F.col("order.status").alias("status"),
        F.col("order.amount").alias("amount"), F.col("order.estimate_arrive_time").alias("arrive_time"),
        F.col("cargo.weight").alias("weight"), F.col("cargo.create_time").alias("cargo_time"))


def log_order_facts(spark, sf_dir):
    """From raw JSON text to facts in one job."""
    log = changes.order_changes(standins.order_log(spark, sf_dir), wanted_fields(["order_id", "amount"]))
    return facts.waybill_detail(join_orders_batch(log), columns=["order_id", "amount"])


def _at_once(spark: SparkSession, topic: str) -> str:
    return str(streams.files_at_once(len(files.names(spark, topic))))


def topic_round_trip(spark, sf_dir):
    """The raw log written to a topic, read as a stream in several micro-batches, and joined to facts."""
    topic, target, checkpoint = (shared_dir(spark, f"topic-{x}") for x in ("log", "read", "checkpoint"))
    standins.order_log(spark, sf_dir).select("value").write.text(topic, compression="gzip")
    raw = changes.read_changes(spark, topic, "dwd", fmt="text", maxFilesPerTrigger=_at_once(spark, topic))
    # What is kept of the messages is the fields the facts need, not their text a second time.
    read = changes.order_changes(raw, wanted_fields(["order_id", "amount"]))
    streams.finish(read.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target))
    log = spark.read.schema(read.schema).parquet(target)
    return facts.waybill_detail(join_orders_batch(log), columns=["order_id", "amount"])


def topic_twice(spark, sf_dir):
    """The log written to a topic by an at-least-once writer, every third part of it twice, and read once."""
    topic, target, checkpoint = (shared_dir(spark, f"twice-{x}") for x in ("log", "read", "checkpoint"))
    # Messages are made, and kept, as text: their images have too many columns to be written and read as such on the way.
    parts, _ = streams.write_slices(
        spark, standins.order_changes(spark, sf_dir), "parts", ["ts"], made=lambda cut: standins.order_messages(cut, "slice"), compression="zstd")
    part = spark.read.schema("value string, slice int").parquet(parts)
    for sent in (part, part.where("slice % 3 = 2")):
        # A place in the database's log for every event: what tells a message sent twice from two messages.
        events = changes.parse_envelope(sent.withColumn("pos", F.pmod(F.xxhash64("value"), F.lit(1 << 60))), changes.ORDER_OR_CARGO, "pos")
        placed = events.withColumn("source", F.struct(F.col("source.table").alias("table"), F.lit("log.1").alias("file"), "pos", F.lit(0).alias("row"))).drop("pos")
        # A message is ten times its bytes in the parts; files of a topic are read as a whole, so they are as many as tasks.
        streams.in_tasks_of(spark, 8 << 20, lambda placed=placed: topics.write_topic(placed, topic, "text", compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}))
    raw = changes.read_changes(spark, topic, "dwd", fmt="text", maxFilesPerTrigger=_at_once(spark, topic))
    # A message may come again as long as its part does: the topic as a whole spans seven years.
    once = changes.once(changes.order_changes(raw, wanted_fields(["order_id", "amount"])), within="4000 days")
    start = lambda out, ck: once.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
    streams.finish(streams.with_parts(spark, streams.parts_for(spark, topic), start)(target, checkpoint))
    log = spark.read.schema(once.schema).parquet(target)
    return facts.waybill_detail(join_orders_batch(log), columns=["order_id", "amount"])


def hard_order_facts(spark, sf_dir):
    """Facts of waybills that go through the hard cases of the order join."""
    joined = join_orders_batch(standins.hard_changes(spark, sf_dir))
    return joined.select(
        "fact", F.col("cargo.order_id").alias("order_id"), F.col("cargo.id").alias("cargo_id"), F.col("order.status").alias("status"),
        F.col("order.amount").alias("amount"), F.col("order.update_time").alias("order_time"), F.col("cargo.create_time").alias("cargo_time"))


def dim_upsert(spark, sf_dir):
    """A dimension made in the catalog, loaded, changed for every third key, compacted, and read."""
    path, compact, name = shared_dir(spark, "dim"), shared_dir(spark, "dim-compact"), f"dim_{uuid.uuid4().hex}"
    tables.ensure_dim(spark, name, ["id", "name"], path)
    rows = standins.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).cast("long").alias("seq"))
    tables.upsert_dim(rows, path, ["id", "name"], 0, table=name)
    changed = rows.where("id % 3 = 0").select("id", F.upper("name").alias("name"), (F.col("seq") + 1).alias("seq"))
    tables.upsert_dim(changed, path, ["id", "name"], 1, table=name)
    versions = spark.table(name).groupBy("id").agg(F.count("*").alias("versions"))
    tables.compact_dim(spark, path, compact, "id")
    return tables.read_dim(spark, compact, "id").join(versions, "id")


def order_facts_in_slices(spark, sf_dir):
    """The facts with almost every waybill worked in slices, as one that holds a third of the log would be."""
    log = narrow_images(standins.order_changes(spark, sf_dir), ["order_id", "amount"])
    return facts.waybill_detail(join_orders_batch(log, max_rows=2), columns=["order_id", "amount"])


# ---------------------------------------------------------------- dimensions

def _masked(source: Callable, table: str) -> Query:
    return lambda spark, sf_dir: masks.mask_dims(source(spark, sf_dir), table)


def _routed(spark, sf_dir, tables=None):
    return routing.route_dims(changes.dim_changes(standins.dim_log(spark, sf_dir), tables), standins.routing_rows(spark))


def route_dims(spark, sf_dir):
    return _cells(_routed(spark, sf_dir), "columns", "sink_table", "sink_pk", "sink_family", "row_key", "ts")


def dim_latest(spark, sf_dir):
    routed = _routed(spark, sf_dir, ["user_info"]).where("sink_table = 'dim_user_info'").select("sink_table", "row_key", "columns", "ts", "place")
    newest = routing.latest_by_key(routed, ["sink_table", "row_key"], ["ts", "place"])
    return routing.dim_rows(newest, "dim_user_info", ["id", "real_name", "phone_num", "email", "birthday"]).drop("seq")


def dim_columns(spark, sf_dir):
    events = changes.dim_changes(standins.dim_log(spark, sf_dir), ["truck_info"])
    image = routing.keep_columns(F.col("after"), S.csv_items(F.lit("id,truck_no,truck_model_id")))
    return _cells(events.select(F.col("after")["id"].alias("id"), image.alias("image")), "image", "id")


def changed_keys(spark, sf_dir):
    routed = _routed(spark, sf_dir).where("changed is not null")
    return routed.select("sink_table", "row_key", "ts", F.inline("changed"))


def config_latest(spark, sf_dir):
    return routing.config_latest(changes.routing_changes(standins.routing_log(spark, sf_dir)))


def route_dims_as_of(spark, sf_dir):
    """Dimension events by the routing in force at their place in the log, which changes and ends midway."""
    versions = routing.routing_versions(changes.routing_changes(standins.routing_moves(spark)))
    routed = routing.route_dims_as_of(changes.dim_changes(standins.dim_log(spark, sf_dir)), versions)
    return _cells(routed, "columns", "sink_table", "row_key", "ts")


def dims_from_config(spark, sf_dir):
    """Tables made by the routing rows of a scan and of the stream, filled by that stream, and read through the catalog."""
    root, scan, made = shared_dir(spark, "dim-tables"), shared_dir(spark, "config"), f"t{uuid.uuid4().hex}_"
    standins.routing_rows(spark).where("source_table = 'user_info'").write.parquet(scan)
    log = standins.dim_log(spark, sf_dir).union(standins.routing_moves(spark, standins.ROUTING_BIRTHS))
    timed = log.withColumn("at", F.get_json_object("value", "$.ts_ms").cast("long"))
    raw = streams.as_stream(spark, timed, "dim-log", ["at", "value"]).select("value")
    streams.finish(dims.start_dim_tables(
        raw, tables.read_config(spark, scan), lambda sink: made + sink, root, f"{root}/checkpoint", streams.ONCE))
    cells = []
    for sink in ("dim_user_info", "dim_base_organ", "dim_truck_info"):
        rows = routing.latest_by_key(spark.table(made + sink), ["id"], ["seq", "batch_id"])
        named = [c for c in rows.columns if c not in ("seq", "batch_id")]
        cells.append(rows.select(F.lit(sink).alias("sink_table"), F.col("id").alias("row_key"), F.inline(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in named]))).where("value is not null"))
    return reduce(DataFrame.union, cells)


# ---------------------------------------------------------------- facts

def _fact(name: str) -> Query:
    return lambda spark, sf_dir: fact_rows(spark, sf_dir, name)


def _bound(name: str) -> Query:
    return lambda spark, sf_dir: facts.bound_facts(standins.bound_changes(spark, sf_dir))[name]


def mask_order_names(spark, sf_dir):
    return masks.mask_order_names(standins.order_info(spark, sf_dir).select("id", "sender_name", "receiver_name"))


def mask_trip(spark, sf_dir):
    rows = standins.trip_changes(spark, sf_dir).where("op = 'c'").select("after.*")
    return masks.mask_trip(rows.select("id", "driver1_name", "driver2_name", "truck_no"))


# ---------------------------------------------------------------- lookups

def lookup_pk(spark, sf_dir):
    cargo = standins.order_cargo(spark, sf_dir).select("id", "cargo_type")
    return lookups.lookup(cargo, standins.base_dic(spark, sf_dir), "cargo_type", {"name": "cargo_type_name"})


def lookup_fk_first(spark, sf_dir):
    orders = standins.order_info(spark, sf_dir).select("id", "sender_district_id")
    return lookups.lookup_first(
        orders, standins.base_organ(spark, sf_dir), "sender_district_id", "region_id",
        {"id": "org_id", "org_name": "org_name"})


def org_city(spark, sf_dir):
    bounds = standins.bound_changes(spark, sf_dir).where("op = 'c'").select("after.id", "after.org_id")
    return lookups.org_city(bounds, standins.base_organ(spark, sf_dir))


def city_province(spark, sf_dir):
    orders = standins.order_info(spark, sf_dir)
    places = orders.select("id", F.col("sender_city_id").alias("city_id")).union(
        orders.select("id", F.col("sender_district_id")))
    return lookups.city_province(places, standins.base_region_info(spark, sf_dir))


# ---------------------------------------------------------------- summaries

def bound_org_sort_day(spark, sf_dir):
    return summaries.bound_org_sort_day(sort_rows(spark, sf_dir), *org_dims(spark, sf_dir))


def cargo_type_order_day(spark, sf_dir):
    detail = fact_rows(spark, sf_dir, "detail", ["cargo_type", "amount"])
    return summaries.cargo_type_order_day(detail, standins.base_dic(spark, sf_dir))


def org_order_day(spark, sf_dir):
    detail = fact_rows(spark, sf_dir, "detail", ["sender_district_id", "sender_city_id", "amount"])
    return summaries.org_order_day(detail, *org_dims(spark, sf_dir))


def bound_finish_day(spark, sf_dir):
    return summaries.bound_finish_day(fact_rows(spark, sf_dir, "bound_finish", []))


def dispatch_day(spark, sf_dir):
    return summaries.dispatch_day(fact_rows(spark, sf_dir, "dispatch", []))


def org_deliver_suc_day(spark, sf_dir):
    rows = fact_rows(spark, sf_dir, "deliver", ["receiver_district_id", "receiver_city_id", "receiver_province_id"])
    return summaries.org_deliver_suc_day(rows, *org_dims(spark, sf_dir))


def org_receive_day(spark, sf_dir):
    rows = fact_rows(spark, sf_dir, "receive", ["sender_district_id", "sender_city_id", "sender_province_id"])
    return summaries.org_receive_day(rows, *org_dims(spark, sf_dir))


def org_truck_model_day(spark, sf_dir):
    return summaries.org_truck_model_day(
        trips(spark, sf_dir), standins.truck_info(spark, sf_dir), standins.truck_model(spark, sf_dir),
        *org_dims(spark, sf_dir))


# ---------------------------------------------------------------- snapshots and reports

def cumulative_snapshots(spark, sf_dir):
    detail = fact_rows(spark, sf_dir, "detail", ["cargo_type", "amount"])
    return snapshots.cumulative_snapshots(
        detail, ["cargo_type"],
        {"order_amount": F.sum("amount").cast(summaries.MONEY), "order_count": F.count("*")})


def event_snapshots(spark, sf_dir):
    events = standins.table(spark, sf_dir, "events")
    return snapshots.cumulative_snapshots(events, ["event_type"], {"event_count": F.count("*")})


def latest_snapshot(spark, sf_dir):
    return snapshots.latest_snapshot(
        cumulative_snapshots(spark, sf_dir), ["cur_date", "cargo_type"], ["order_amount", "order_count"])


def org_order_series(spark, sf_dir):
    """Running totals per organisation, without names of places."""
    organ, _ = org_dims(spark, sf_dir)
    detail = fact_rows(spark, sf_dir, "detail", ["sender_district_id", "sender_city_id", "amount"])
    rows = lookups.lookup_first(
        detail, organ, "sender_district_id", "region_id", {"id": "org_id", "org_name": "org_name"}
    ).withColumnRenamed("sender_city_id", "city_id")
    return snapshots.cumulative_snapshots(
        rows, ["org_id", "org_name", "city_id"],
        {"order_amount": F.sum("amount").cast(summaries.MONEY), "order_count": F.count("*")}).withColumnRenamed("version", "ts")


def org_order_snapshots(spark, sf_dir):
    """Snapshots of the organisation summary, input of the amount report."""
    named = lookups.lookup(org_order_series(spark, sf_dir), org_dims(spark, sf_dir)[1], "city_id", {"name": "city_name"})
    return named.select(summaries.SUMMARY_COLUMNS["org_order_day"])


def org_sort_series(spark, sf_dir):
    """Running totals per organisation, without names."""
    rows = sort_rows(spark, sf_dir)
    return snapshots.cumulative_snapshots(rows, ["org_id"], {"sort_count": F.count("*")}).withColumnRenamed("version", "ts")


def _org_places(spark, sf_dir):
    organ, region = org_dims(spark, sf_dir)
    return lambda df: lookups.city_province(lookups.org_city(df, organ), region)


def org_sort_snapshots(spark, sf_dir):
    """Snapshots of the sorting summary, input of the province report."""
    named = _org_places(spark, sf_dir)(org_sort_series(spark, sf_dir))
    return named.select(summaries.SUMMARY_COLUMNS["bound_org_sort_day"])


def latest_after_fold(spark, sf_dir):
    """Amounts per day from versions that came in six batches, two for each run of years, and were folded twice on the way."""
    versions = org_order_series(spark, sf_dir)
    path = shared_dir(spark, "series")
    versions.write.parquet(path)
    written = spark.read.schema(versions.schema).parquet(path)
    store = VersionedTable(shared_dir(spark, "folded"), versions.schema, ["cur_date", "org_id", "org_name", "city_id"], ["ts"], "cur_date")
    year = F.year("cur_date")
    batch = 2 * F.when(year <= 1994, 0).when(year <= 1996, 1).otherwise(2) + F.when(F.hour(F.col("ts") + S.local_shift()) < 12, 0).otherwise(1)
    for k in range(6):
        store.write(written.where(batch == k), k)
        if k in (1, 3):
            store.fold(spark)
    return reports.order_amount_by_day(store.versions(spark))


def refreshed_names(spark, sf_dir):
    """Names in a summary after organisations and regions changed: only rows that show them have a second version."""
    name, facts_of = "bound_org_sort_day", ["org_id", "sort_count"]
    rows = bound_org_sort_day(spark, sf_dir).withColumn("ts", F.timestamp_millis(F.lit(1000)))
    store = VersionedTable(shared_dir(spark, "named"), rows.schema, ["cur_date", "org_id"], ["ts"])
    store.write(rows, 0)
    config = standins.routing_rows(spark).union(standins.region_route(spark))
    routed = routing.route_dims(changes.dim_changes(standins.name_log(spark, sf_dir)), config).drop("sink_family")
    # Rows of one id at one place of the log: one without a parent stays, as in `lookups.first_by_id`; then the last in text order.
    told = routed.withColumns({"whole": F.element_at("columns", F.lit("org_parent_id")).isNull(), "told": F.map_entries("columns")})
    newest = routing.latest_by_key(told, ["sink_table", "row_key"], ["ts", "place", "whole", "told"])
    organ = routing.dim_rows(newest, "dim_base_organ", ["id", "org_name", "org_parent_id", "region_id"])
    region = routing.dim_rows(newest, "dim_base_region_info", ["id", "parent_id", "name", "dict_code"])
    changed = refresh.with_children(refresh.changed_rows(routed), organ)
    again = refresh.refreshed(
        store.read(spark), changed, name, facts_of, lambda df: lookups.city_province(lookups.org_city(df, organ), region))
    store.write(again.withColumn("ts", F.timestamp_millis(F.lit(2000))), 1)
    return store.read(spark)


def order_amount_today(spark, sf_dir):
    """The amount report without a date, over the series moved so that its last day is the current business day."""
    series = org_order_series(spark, sf_dir)
    last = series.agg(F.max("cur_date").alias("last"))
    today = S.local_day(F.current_timestamp())
    moved = series.join(F.broadcast(last)).withColumn("cur_date", F.date_add("cur_date", F.datediff(today, "last"))).drop("last")  # one row
    return reports.order_amount(moved).withColumn("today", today)


def order_amount(spark, sf_dir):
    return reports.order_amount(org_order_series(spark, sf_dir), REPORT_DATE)


def order_amount_by_day(spark, sf_dir):
    return reports.order_amount_by_day(org_order_series(spark, sf_dir))


def sort_count_by_province(spark, sf_dir):
    return reports.sort_count_by_province(org_sort_series(spark, sf_dir), REPORT_DATE, names=_org_places(spark, sf_dir))


def sort_count_by_province_by_day(spark, sf_dir):
    return reports.sort_count_by_province(org_sort_series(spark, sf_dir), every_day=True, names=_org_places(spark, sf_dir))


def map_payload(spark, sf_dir):
    report = sort_count_by_province_by_day(spark, sf_dir)
    return reports.map_payload(report, by=["cur_date"]).withColumn("map_data", F.to_json("map_data"))


# ---------------------------------------------------------------- scalar functions

def time_functions(spark, sf_dir):
    ts = F.date_trunc("millisecond", F.col("ts"))
    wall = S.millis(ts + S.local_shift()).cast("string")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return standins.table(spark, sf_dir, "events").select(
        "event_id", S.millis(ts).alias("ms"), S.text_day(ts).alias("day"), S.text_time(ts).alias("full_time"),
        S.compact_day(ts).alias("compact"), S.local_day(ts).alias("local_day"),
        S.millis(S.instant_of_wall_millis(wall)).alias("wall_ms"), S.millis(S.instant_of_iso(iso)).alias("iso_ms"),
        S.millis(S.instant_of_local_text(S.text_time(ts))).alias("local_ms"),
        S.date_of_epoch_days(F.col("event_id").cast("int")).alias("epoch_day"))


def text_functions(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.col("event_type"))
    return standins.table(spark, sf_dir, "events").select(
        "event_id", S.utf8(raw.cast("binary")).alias("payload"), S.mask_name(F.col("event_type")).alias("masked"),
        F.md5("event_type").alias("digest"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.array_contains(S.csv_items(F.lit("click,view")), F.col("event_type")).alias("listed"),
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("pair"))


_QUERIES: dict[str, Query] = {
    "live_changes": live_changes,
    "table_filter": table_filter,
    "envelope_fields": envelope_fields,
    "log_order_facts": log_order_facts,
    "order_facts_in_slices": order_facts_in_slices,
    "topic_round_trip": topic_round_trip,
    "topic_twice": topic_twice,
    "hard_order_facts": hard_order_facts,
    "dim_upsert": dim_upsert,
    "mask_customers": _masked(standins.user_info, "user_info"),
    "mask_addresses": _masked(standins.user_address, "user_address"),
    "mask_employees": _masked(standins.employee_info, "employee_info"),
    "mask_couriers": _masked(standins.express_courier, "express_courier"),
    "mask_drivers": _masked(standins.truck_driver, "truck_driver"),
    "mask_trucks": _masked(standins.truck_info, "truck_info"),
    "mask_truck_models": _masked(standins.truck_model, "truck_model"),
    "mask_order_names": mask_order_names,
    "mask_trip": mask_trip,
    "route_dims": route_dims,
    "dim_latest": dim_latest,
    "dim_columns": dim_columns,
    "changed_keys": changed_keys,
    "config_latest": config_latest,
    "route_dims_as_of": route_dims_as_of,
    "dims_from_config": dims_from_config,
    "order_detail": _fact("detail"),
    "pay_suc": _fact("pay_suc"),
    "cancel": _fact("cancel"),
    "receive": _fact("receive"),
    "dispatch": _fact("dispatch"),
    "bound_finish": _fact("bound_finish"),
    "deliver": _fact("deliver"),
    "sign": _fact("sign"),
    "inbound": _bound("inbound"),
    "sort": _bound("sort"),
    "outbound": _bound("outbound"),
    "trip_finish": trips,
    "lookup_pk": lookup_pk,
    "lookup_fk_first": lookup_fk_first,
    "org_city": org_city,
    "city_province": city_province,
    "bound_org_sort_day": bound_org_sort_day,
    "cargo_type_order_day": cargo_type_order_day,
    "org_order_day": org_order_day,
    "bound_finish_day": bound_finish_day,
    "dispatch_day": dispatch_day,
    "org_deliver_suc_day": org_deliver_suc_day,
    "org_receive_day": org_receive_day,
    "org_truck_model_day": org_truck_model_day,
    "cumulative_snapshots": cumulative_snapshots,
    "event_snapshots": event_snapshots,
    "latest_snapshot": latest_snapshot,
    "org_order_snapshots": org_order_snapshots,
    "org_sort_snapshots": org_sort_snapshots,
    "latest_after_fold": latest_after_fold,
    "refreshed_names": refreshed_names,
    "order_amount_today": order_amount_today,
    "order_amount": order_amount,
    "order_amount_by_day": order_amount_by_day,
    "sort_count_by_province": sort_count_by_province,
    "sort_count_by_province_by_day": sort_count_by_province_by_day,
    "map_payload": map_payload,
    "time_functions": time_functions,
    "text_functions": text_functions,
    **streams.QUERIES,
}


def _reported(query: Query) -> Query:
    return lambda spark, sf_dir: as_wire(query(prepare(spark), sf_dir.rstrip("/")))


def queries() -> dict[str, Query]:
    return {name: _reported(query) for name, query in _QUERIES.items()}
