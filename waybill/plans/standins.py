"""Freight tables derived from the star-schema parquet tables (see FIXTURES.md).

Every function returns a lazy DataFrame whose size grows with the tables it reads. Nothing here
numbers or collects rows within an order, so no order, however large, has to pass through one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.functions.scalars import local_shift, millis
from waybill.schemas import CONFIG_TABLE
from waybill.sources import files

# Status codes of a waybill in the order they are reached, and the code of a cancel.
STATUS_CODES = ["60010", "60020", "60030", "60040", "60050", "60060", "60070", "60080"]
CANCEL_CODE = "60999"


# Schema, number of splits and bytes of the tables a session has seen, so that a table used several times in a plan is not opened each time.
_SEEN: dict[tuple[str, str], tuple[T.StructType, int, int]] = {}

# Tables that grow with the business; the others describe it.
FACT_TABLES = ("orders", "lineitem")
# Most bytes of a table's files for one task, where what is made of a row (changes, each a long text) is many times its size.
MOST_BYTES = {"orders": 2 << 20, "customer": 1 << 20}


def _look(spark: SparkSession, sf_dir: str, name: str) -> tuple[T.StructType, int, int]:
    path = f"{sf_dir}/{name}.parquet"
    key = spark.sparkContext.applicationId, path
    if key not in _SEEN:
        df = spark.read.parquet(path)
        _SEEN[key] = df.schema, df.rdd.getNumPartitions(), files.size(spark, path)
    return _SEEN[key]


def schema_of(spark: SparkSession, sf_dir: str, name: str) -> T.StructType:
    return _look(spark, sf_dir, name)[0]


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """One given table; zone-less times are UTC instants.

    A fact table of fewer splits than cores (a small test file) is spread over the cores first, and a table of MOST_BYTES over as many tasks as that
    gives, so that their number grows with the table and not their work. Others of normal size have many splits and are read in place.
    """
    schema, splits, size = _look(spark, sf_dir, name)
    df = spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")
    parts = max(spark.sparkContext.defaultParallelism if name in FACT_TABLES else 1, -(-size // MOST_BYTES.get(name, size or 1)))
    if spread and splits < parts:
        df = df.repartition(parts)
    ntz = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz})


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def _later(start: Column, seconds: Column) -> Column:
    """An instant some seconds after another, in whole-number arithmetic."""
    return F.timestamp_micros(F.unix_micros(start) + seconds.cast("long") * 1_000_000)


def _wall_millis(instant: Column) -> Column:
    return millis(instant + local_shift())


def _iso(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# ---------------------------------------------------------------- dimensions

def base_region_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    provinces = region.select(
        _text(1000 + F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"),
        F.col("r_name").alias("name"), F.lit("Province").alias("dict_code"))
    cities = nation.select(
        _text(100 + F.col("n_nationkey")), _text(1000 + F.col("n_regionkey")), F.col("n_name"), F.lit("City"))
    districts = nation.select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        _text(2000 + F.col("n_nationkey") * 4 + F.col("k")), _text(100 + F.col("n_nationkey")),
        F.concat("n_name", F.lit("-D"), _text("k")), F.lit("District"))
    return provinces.union(cities).union(districts)


def base_organ(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = table(spark, sf_dir, "nation").select(
        _text(9000 + F.col("n_nationkey")).alias("id"), F.concat(F.lit("Hub "), "n_name").alias("org_name"),
        F.lit(None).cast("string").alias("org_parent_id"), _text(100 + F.col("n_nationkey")).alias("region_id"))
    stations = table(spark, sf_dir, "supplier").select(
        _text("s_suppkey"), F.col("s_name"), _text(9000 + F.col("s_nationkey")),
        _text(2000 + F.col("s_nationkey") * 4 + F.col("s_suppkey") % 4))
    return hubs.union(stations)


def base_dic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("id"), F.lower("p_type").alias("name")).distinct()


def truck_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        _text("p_partkey").alias("id"), F.col("p_brand").alias("truck_model_id"), F.col("p_name").alias("truck_no"),
        F.concat(F.lit("gps"), _text("p_partkey")).alias("device_gps_id"),
        F.concat(F.lit("eng"), _text("p_size")).alias("engine_no"))


def truck_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("id"), F.concat(F.lit("Model "), "p_brand").alias("model_name"),
        F.concat(F.lit("M-"), "p_brand").alias("model_no")).distinct()


def _phone(key: Column, bad: Column) -> Column:
    digits = F.substring(_text(F.lit(100000000) + key), 2, 8)
    return F.when(bad, F.lit("999")).otherwise(F.concat(F.lit("138"), digits))


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _text(key).alias("id"), F.col("c_name").alias("real_name"), F.concat(F.lit("pw"), _text(key)).alias("passwd"),
        _phone(key, key % 5 == 0).alias("phone_num"),
        F.when(key % 7 == 0, "bad").otherwise(F.concat(F.lit("u"), _text(key), F.lit("@mail.com"))).alias("email"),
        (3650 + key % 10000).cast("int").alias("birthday"))


def user_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _text(key).alias("id"), _text(key).alias("user_id"), _phone(key, key % 4 == 0).alias("phone"),
        F.concat(F.lit("Street "), _text(key)).alias("address"))


def employee_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _text(key).alias("id"), F.concat(F.lit("pw"), _text(key)).alias("password"), F.col("s_name").alias("real_name"),
        F.concat(F.lit("card"), _text(key)).alias("id_card"), _phone(key, key % 6 == 0).alias("phone"))


def express_courier(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _text(key).alias("id"), _text(key).alias("emp_id"), _text(9000 + F.col("s_nationkey")).alias("org_id"),
        _phone(key, key % 3 == 0).alias("working_phone"))


def truck_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _text(key).alias("id"), _text(key).alias("emp_id"), F.concat(F.lit("LIC"), _text(key)).alias("license_no"))


# ---------------------------------------------------------------- orders and cargo

def order_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One waybill per order."""
    orders = table(spark, sf_dir, "orders")
    nation = table(spark, sf_dir, "nation")
    sender = nation.select(F.col("n_nationkey").alias("sn"), F.col("n_regionkey").alias("sr"))
    receiver = nation.select(F.col("n_nationkey").alias("rn"), F.col("n_regionkey").alias("rr"))
    key, cust, city = F.col("o_orderkey"), F.col("c_custkey"), F.col("c_nationkey")
    created = _later(F.col("o_orderdate"), key * 37 % 86400)
    return (
        orders.join(table(spark, sf_dir, "customer", spread=False), F.col("o_custkey") == cust)
        .join(sender, F.col("sn") == city)
        .join(receiver, F.col("rn") == (city + 7) % 25)
        .select(
            _text(key).alias("id"), F.concat(F.lit("WB"), _text(key)).alias("order_no"),
            _text(1 + key % 2).alias("collect_type"), _text(cust).alias("user_id"),
            _text(30000 + F.col("rn") * 10 + key % 10).alias("receiver_complex_id"),
            _text(1000 + F.col("rr")).alias("receiver_province_id"), _text(100 + F.col("rn")).alias("receiver_city_id"),
            _text(2000 + F.col("rn") * 4 + key % 4).alias("receiver_district_id"),
            F.concat(F.lit("R"), "c_mktsegment").alias("receiver_name"),
            _text(30000 + city * 10 + cust % 10).alias("sender_complex_id"),
            _text(1000 + F.col("sr")).alias("sender_province_id"), _text(100 + city).alias("sender_city_id"),
            _text(2000 + city * 4 + cust % 4).alias("sender_district_id"), F.col("c_name").alias("sender_name"),
            F.col("o_orderpriority").alias("payment_type"), (1 + key % 5).cast("int").alias("cargo_num"),
            F.col("o_totalprice").cast("decimal(20,2)").alias("amount"),
            (created + F.expr("interval 72 hours")).alias("estimate_arrive_time"),
            (key % 1000).cast("decimal(20,2)").alias("distance"), created.alias("create_time"))
    )


def order_cargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as one piece of cargo: 1 s before, 1 s after or 8 s after the order was placed.

    Lines are added up with whole-number and floating aggregates only, which Spark hashes before the
    shuffle without sorting.
    """
    key = F.col("l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    delay = F.when(key % 10 == 0, 8).when(key % 2 == 0, 1).otherwise(-1)
    pieces = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("part"), F.max("l_quantity").alias("longest"),
        F.max("l_linenumber").alias("lines"), F.sum("l_quantity").alias("total"))
    return (
        pieces.join(orders, key == F.col("o_orderkey"))
        .join(parts, F.col("part") == F.col("p_partkey"))
        .select(
            _text(key * 100 + 1).alias("id"), _text(key).alias("order_id"), F.col("p_type").alias("cargo_type"),
            F.col("longest").cast("int").alias("volumn_length"), (key % 50 + 1).cast("int").alias("volumn_width"),
            F.col("lines").cast("int").alias("volumn_height"), F.col("total").cast("decimal(20,2)").alias("weight"),
            _later(F.col("o_orderdate"), key * 37 % 86400 + delay).alias("create_time"))
    )


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed change log of orders and cargo; see `sources.changes.order_changes` for the columns.

    A create, up to seven status updates six hours apart, and a cancel after 60 hours for every 13th
    order. Each order is read and joined once and repeated by an explode of step numbers.
    """
    number = F.col("id").cast("long")
    last = F.least(number % 9, F.lit(7)).cast("int")
    cancel = len(STATUS_CODES)
    steps = F.concat(
        F.sequence(F.lit(0), last),
        F.when((number % 13 == 0) & (number % 9 < 7), F.array(F.lit(cancel))).otherwise(F.array().cast("array<int>")))
    info = order_info(spark, sf_dir)
    columns = info.columns
    codes = F.array(*[F.lit(c) for c in STATUS_CODES])
    step = F.col("step")
    orders = info.select("*", F.explode(steps).alias("step")).withColumns({
        "before_status": F.when(step == cancel, F.get(codes, (number % 9).cast("int"))).otherwise(F.get(codes, step - 1)),
        "status": F.when(step == cancel, CANCEL_CODE).otherwise(F.get(codes, step)),
        "ts": _later(F.col("create_time"), F.when(step == cancel, 216000).otherwise(step * 21600)),
    }).select(
        F.col("id").alias("order_id"), F.lit("order_info").alias("tbl"),
        F.when(step == 0, "c").otherwise("u").alias("op"), "ts", "before_status",
        F.struct("id", "order_no", "status", *columns[2:], F.col("ts").alias("update_time")).alias("order"))
    cargo_df = order_cargo(spark, sf_dir)
    cargo = cargo_df.select(
        "order_id", F.lit("order_cargo").alias("tbl"), F.lit("c").alias("op"), F.col("create_time").alias("ts"),
        F.lit(None).cast("string").alias("before_status"), F.struct(*cargo_df.columns).alias("cargo"))
    return orders.unionByName(cargo, allowMissingColumns=True)


# ---------------------------------------------------------------- warehouse and trips

def _line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _arrival() -> Column:
    return _later(F.col("l_shipdate"), F.col("l_orderkey") * 53 % 86400)


def bound_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse passage per line: op, before, after. Times are wall-clock digits as on the wire.

    Every fifth line number is never sorted, the one before it never leaves; line 7 is sorted and
    sent out by one update.
    """
    line, hours = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    steps = (
        F.when(line % 5 == 0, F.array(F.lit("in")))
        .when(line % 5 == 4, F.array(F.lit("in"), F.lit("sort")))
        .when(line == 7, F.array(F.lit("in"), F.lit("both")))
        .otherwise(F.array(F.lit("in"), F.lit("sort"), F.lit("out"))))
    arrival, step = _arrival(), F.col("step")
    lines = table(spark, sf_dir, "lineitem").select(
        _line_id().alias("id"), _text("l_orderkey").alias("order_id"), _text("l_suppkey").alias("org_id"),
        _text(_wall_millis(arrival)).alias("inbound"), _text(_wall_millis(_later(arrival, 3600 * hours))).alias("sort"),
        _text(_wall_millis(_later(arrival, 7200 * hours))).alias("outbound"),
        _text(F.col("l_suppkey") * 10 + line).alias("emp"), F.explode(steps).alias("step"))

    def image(sorted_: Column, left: Column) -> Column:
        return F.struct(
            F.col("id"), F.col("order_id"), F.col("org_id"), F.col("inbound").alias("inbound_time"),
            F.col("emp").alias("inbound_emp_id"), F.when(sorted_, F.col("sort")).alias("sort_time"),
            F.when(sorted_, F.col("emp")).alias("sorter_emp_id"), F.when(left, F.col("outbound")).alias("outbound_time"),
            F.when(left, F.col("emp")).alias("outbound_emp_id"))

    return lines.select(
        F.when(step == "in", "c").otherwise("u").alias("op"),
        F.when(step != "in", image(step == "out", F.lit(False))).alias("before"),
        image(step != "in", step.isin("out", "both")).alias("after"))


def trip_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip per line: op, before, after. Open trips get an update that sets no end time."""
    line = F.col("l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    ended = F.col("l_linestatus") == "F"
    trips = (
        table(spark, sf_dir, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            _line_id().alias("id"), _text("l_suppkey").alias("start_org_id"), F.col("s_name").alias("start_org_name"),
            line.cast("int").alias("order_num"), F.col("s_name").alias("driver1_name"),
            F.when(line % 2 == 0, F.col("p_name")).alias("driver2_name"), _text("l_partkey").alias("truck_id"),
            F.col("p_name").alias("truck_no"), _text(_wall_millis(_arrival())).alias("actual_start_time"),
            F.when(ended, _text(_wall_millis(_later(_arrival(), 1800 * F.col("l_quantity").cast("int"))))).alias("end"),
            F.col("l_extendedprice").cast("decimal(20,2)").alias("actual_distance"))
    )

    def image(end: Column) -> Column:
        return F.struct(*[F.col(c) for c in trips.columns if c != "end"], end.alias("actual_end_time"))

    steps = trips.select("*", F.explode(F.array(F.lit("c"), F.lit("u"))).alias("op"))
    update = F.col("op") == "u"
    running = F.lit(None).cast("string")
    return steps.select(
        "op", F.when(update, image(running)).alias("before"), image(F.when(update, F.col("end"))).alias("after"))


# ---------------------------------------------------------------- raw log (JSON text)

def _envelope(table_name: str, op: Column, before: Column, after: Column, ts_ms: Column) -> Column:
    return F.to_json(F.struct(
        op.alias("op"), before.alias("before"), after.alias("after"),
        F.struct(F.lit(table_name).alias("table")).alias("source"), ts_ms.alias("ts_ms"),
        F.struct(F.lit("t0").alias("id")).alias("transaction")))


def _order_wire(image: Column) -> Column:
    """Typed order image back to its wire form: ISO texts and wall-clock milliseconds."""
    return (
        image.withField("create_time", _iso(image["create_time"]))
        .withField("update_time", _iso(image["update_time"]))
        .withField("estimate_arrive_time", _wall_millis(image["estimate_arrive_time"]))
    )


def _cargo_wire(image: Column) -> Column:
    return image.withField("create_time", _iso(image["create_time"]))


def order_log(spark: SparkSession, sf_dir: str, arranged: Callable[[DataFrame], DataFrame] = lambda changes: changes) -> DataFrame:
    """Raw log of orders and cargo as JSON text in a `value` column.

    Besides the changes of `order_changes` it holds deletes (every 11th order), updates that lost
    their image (every 17th) and snapshot reads (every 19th), which later steps must ignore. `arranged` may deal out and sort the changes
    before they become text, which is longer and takes longer to make; the events of a change stay where it is.
    """
    return order_messages(arranged(order_changes(spark, sf_dir)))


def order_messages(changes: DataFrame, *kept: str) -> DataFrame:
    """The events of `order_log` for some changes of orders and cargo, beside the columns `kept`."""
    # Images in their wire form before the events are unfolded: once for a change, not for each image of each event.
    changes = changes.withColumns({"order": _order_wire(F.col("order")), "cargo": _cargo_wire(F.col("cargo"))})
    number = F.col("order_id").cast("long")
    placed = (F.col("tbl") == "order_info") & (F.col("op") == "c")

    def kind(op: Column, before: Column, after: Column) -> Column:
        return F.struct(op.alias("event_op"), before.alias("has_before"), after.alias("has_after"))

    yes, no = F.lit(True), F.lit(False)
    kinds = F.array(
        kind(F.col("op"), (F.col("tbl") == "order_info") & (F.col("op") == "u"), yes),
        F.when(placed & (number % 11 == 0), kind(F.lit("d"), yes, no)),
        F.when(placed & (number % 17 == 0), kind(F.lit("u"), yes, no)),
        F.when(placed & (number % 19 == 0), kind(F.lit("r"), no, yes)))
    events = changes.select("*", F.inline(F.array_compact(kinds)))
    order, cargo = F.col("order"), F.col("cargo")
    old = order.withField("status", F.coalesce("before_status", "order.status"))
    return events.select(*kept, F.when(
        F.col("tbl") == "order_cargo", _envelope("order_cargo", F.col("event_op"), F.when(no, cargo), cargo, millis(F.col("ts")))
    ).otherwise(_envelope(
        "order_info", F.col("event_op"), F.when(F.col("has_before"), old), F.when(F.col("has_after"), order), millis(F.col("ts")))
    ).alias("value"))


def _log_of(name: str, df: DataFrame, updates: list) -> DataFrame:
    """Each row as a snapshot read, plus (happens, column, old, new, time) updates; one pass."""
    image = F.struct(*df.columns)
    events = [_envelope(name, F.lit("r"), F.when(F.lit(False), image), image, F.lit(1000).cast("long"))]
    events += [
        F.when(happens, _envelope(name, F.lit("u"), image.withField(column, old), image.withField(column, new),
                                  F.lit(at).cast("long")))
        for happens, column, old, new, at in updates]
    return df.select(F.explode(F.array_compact(F.array(*events))).alias("value"))


def dim_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log of dimension tables: a snapshot read of every row, then some updates.

    Every third customer changes the e-mail address, every sixth once more; every second station
    moves to the next district. `base_region_info` has no routing row.
    """
    number = F.col("id").cast("long")

    def email(generation: int) -> Column:
        return F.concat(F.lit(f"g{generation}-"), F.col("id"), F.lit("@mail.com"))

    moved = _text(F.col("region_id").cast("long") + 1)
    station = F.col("org_parent_id").isNotNull() & (number % 2 == 0)
    parts = [
        _log_of("user_info", user_info(spark, sf_dir), [
            (number % 3 == 0, "email", F.col("email"), email(2), 2000),
            (number % 6 == 0, "email", email(2), email(3), 3000)]),
        _log_of("base_organ", base_organ(spark, sf_dir), [(station, "region_id", F.col("region_id"), moved, 2000)]),
        _log_of("truck_info", truck_info(spark, sf_dir), []),
        _log_of("base_region_info", base_region_info(spark, sf_dir), []),
    ]
    return reduce(DataFrame.union, parts)


def routing_rows(spark: SparkSession) -> DataFrame:
    """Routing rows of the dimension branch (one per dimension table)."""
    return spark.sql("""
        SELECT * FROM VALUES
          ('user_info', 'dim_user_info', CAST(NULL AS string), 'id,real_name,passwd,phone_num,email,birthday', 'id', CAST(NULL AS string)),
          ('base_organ', 'dim_base_organ', NULL, 'id,org_name,org_parent_id,region_id', 'id', 'region_id'),
          ('truck_info', 'dim_truck_info', 'info', 'id,truck_no,truck_model_id', 'id', 'truck_model_id')
        AS routes(source_table, sink_table, sink_family, sink_columns, sink_pk, foreign_keys)""")


def name_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log of organisations and regions, then changes of what summaries show.

    Every third station and every fourth city get another name, every fifth hub another city, one province another name.
    """
    number = F.col("id").cast("long")
    station, hub = F.col("org_parent_id").isNotNull(), F.col("org_parent_id").isNull()
    moved = _text(100 + (F.col("region_id").cast("long") - 100 + 1) % 25)
    renamed = F.concat("name", F.lit("*"))
    return _log_of("base_organ", base_organ(spark, sf_dir), [
        (station & (number % 3 == 0), "org_name", F.col("org_name"), F.concat("org_name", F.lit(" II")), 2000),
        (hub & (number % 5 == 0), "region_id", F.col("region_id"), moved, 2000)],
    ).union(_log_of("base_region_info", base_region_info(spark, sf_dir), [
        ((F.col("dict_code") == "City") & (number % 4 == 0), "name", F.col("name"), renamed, 2000),
        ((F.col("dict_code") == "Province") & (number == 1001), "name", F.col("name"), renamed, 2000)]))


def region_route(spark: SparkSession) -> DataFrame:
    """The routing row of regions, which `routing_rows` leaves out."""
    return spark.sql("""
        SELECT 'base_region_info' source_table, 'dim_base_region_info' sink_table, CAST(NULL AS string) sink_family, 'id,parent_id,name,dict_code' sink_columns,
          'id' sink_pk, 'parent_id' foreign_keys""")


# Changes of routing rows in the course of `dim_log` (whose events are of 1000, 2000 and 3000): time, operation, table, columns.
ROUTING_MOVES = [
    (0, "c", "user_info", "id,real_name"), (1500, "u", "user_info", "id,email"), (2500, "d", "user_info", ""),
    (1500, "c", "base_organ", "id,region_id"), (1000, "r", "truck_info", "id,truck_no")]
ROUTING_BIRTHS = [
    (500, "c", "truck_info", "id,truck_no"), (1500, "c", "base_organ", "id,org_name,region_id"), (2500, "d", "user_info", "")]


def routing_moves(spark: SparkSession, moves: list[tuple] = ROUTING_MOVES) -> DataFrame:
    """Raw log of changes of routing rows."""
    rows = spark.createDataFrame(moves, "at long, op string, name string, listed string")
    image = F.struct(
        F.col("name").alias("source_table"), F.concat(F.lit("dim_"), "name").alias("sink_table"), F.col("listed").alias("sink_columns"), F.lit("id").alias("sink_pk"))
    gone = F.col("op") == "d"
    return rows.select(_envelope(CONFIG_TABLE, F.col("op"), F.when(gone, image), F.when(~gone, image), F.col("at")).alias("value"))


# What can happen to a waybill, by key modulo 6: seconds after placement, table, operation, statuses before and after, cargo number.
# Updates after a cancel and after signing, a second cargo row, a cargo update, two placements before the cargo, changes of one instant.
HARD_CASES = [
    (0, -1, "order_cargo", "c", None, None, 1), (0, 0, "order_info", "c", None, "60010", None), (0, 10, "order_info", "u", "60010", "60999", None),
    (0, 20, "order_info", "u", "60010", "60020", None), (0, 30, "order_cargo", "c", None, None, 2), (0, 40, "order_info", "u", "60020", "60030", None),
    (1, -1, "order_cargo", "c", None, None, 1), (1, 0, "order_info", "c", None, "60010", None), (1, 10, "order_info", "u", "60070", "60080", None),
    (1, 20, "order_info", "u", "60080", "60999", None),
    (2, 0, "order_info", "c", None, "60010", None), (2, 1, "order_cargo", "c", None, None, 1), (2, 2, "order_cargo", "c", None, None, 2),
    (2, 10, "order_info", "u", "60010", "60020", None),
    (3, -1, "order_cargo", "c", None, None, 1), (3, 0, "order_info", "c", None, "60010", None), (3, 5, "order_cargo", "u", None, None, 2),
    (3, 10, "order_info", "u", "60010", "60020", None), (3, 15, "order_info", "u", "60030", "60040", None), (3, 20, "order_info", "r", "60010", "60020", None),
    (4, 0, "order_info", "c", None, "60010", None), (4, 3, "order_info", "c", None, "60010", None), (4, 4, "order_cargo", "c", None, None, 1),
    (4, 8, "order_cargo", "c", None, None, 2), (4, 9, "order_info", "u", "60020", "60030", None),
    (5, 0, "order_cargo", "c", None, None, 1), (5, 0, "order_info", "c", None, "60010", None), (5, 10, "order_info", "u", "60020", "60030", None),
    (5, 10, "order_info", "u", "60010", "60020", None), (5, 20, "order_info", "u", "60040", "60050", None), (5, 20, "order_info", "u", "60050", "60999", None)]


def hard_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed change log with the hard cases of the order join: each order goes through those of its key."""
    key, case = F.col("o_orderkey"), F.col("case")
    listed = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind", "after", "tbl", "op", "s0", "s1", "number"), row)]) for row in HARD_CASES]
    kinds = "struct<kind: int, after: int, tbl: string, op: string, s0: string, s1: string, number: int>"
    cases = F.array(*[c.cast(kinds) for c in listed])
    rows = table(spark, sf_dir, "orders").select(
        key, "o_orderdate", "o_totalprice", F.explode(F.filter(cases, lambda c: c["kind"] == key % 6)).alias("case"))
    at, is_order = _later(F.col("o_orderdate"), key * 37 % 86400 + case["after"]), case["tbl"] == "order_info"
    return rows.select(
        _text(key).alias("order_id"), case["tbl"].alias("tbl"), case["op"].alias("op"), at.alias("ts"), case["s0"].alias("before_status"),
        F.when(is_order, F.struct(
            _text(key).alias("id"), case["s1"].alias("status"), at.alias("update_time"), F.col("o_totalprice").cast("decimal(20,2)").alias("amount"))).alias("order"),
        F.when(~is_order, F.struct(
            _text(key * 10 + case["number"]).alias("id"), _text(key).alias("order_id"), at.alias("create_time"))).alias("cargo"))


def routing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of routing rows made from user events: one source table per user."""
    row = F.struct(
        F.concat(F.lit("table_"), _text("user_id")).alias("source_table"),
        F.concat(F.lit("dim_"), _text("event_id")).alias("sink_table"),
        F.concat(F.lit("id,"), "event_type").alias("sink_columns"), F.lit("id").alias("sink_pk"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("foreign_keys"))
    op = (F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "c")
          .when(F.col("event_type") == "view", "r").otherwise("u"))
    no_row = F.when(F.lit(False), row)
    return table(spark, sf_dir, "events").select(
        _envelope(CONFIG_TABLE, op, F.when(op.isin("d", "u"), row), F.when(op != "d", row).otherwise(no_row),
                  F.col("event_id")).alias("value"))
