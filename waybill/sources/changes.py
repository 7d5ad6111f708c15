"""Reading, cleaning and typing the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill import schemas
from waybill.functions import scalars as S
from waybill.sources.topics import read_topic


def table_of(value: Column | str = "value") -> Column:
    """Source table of a raw event, read without parsing the images."""
    return F.get_json_object(value, "$.source.table")


def read_changes(
    spark: SparkSession, topic: str, group: str, start: str | None = None, fmt: str = "text",
    streaming: bool = True, since_ms: int | None = None, tables: list[str] | None = None, **options: str,
) -> DataFrame:
    """Raw events (`value`) of one table group, or of its `tables` where a deployment names them otherwise.

    `start` is `initial` (snapshot reads, then changes) or `latest`; each group has its default. It says where a
    broker is read from when there is no checkpoint yet; afterwards the checkpoint decides, so nothing that
    arrives while a job is down is lost. A folder of files has no offsets: all its files are read once. `since_ms` is
    a fixed starting point on top of that, given by the caller and the same at every restart.
    """
    if group not in schemas.TABLE_GROUPS:
        raise ValueError(f"unknown table group {group!r}: choose one of {sorted(schemas.TABLE_GROUPS)}")
    start = start or schemas.GROUP_START[group]
    if fmt == "kafka":
        options.setdefault("startingOffsets", "latest" if start == "latest" else "earliest")
    raw = read_topic(spark, topic, fmt, streaming=streaming, **options)
    raw = raw.where(table_of().isin(tables or schemas.TABLE_GROUPS[group]))
    if since_ms is not None:
        raw = raw.where(F.get_json_object("value", "$.ts_ms").cast("long") >= since_ms)
    return raw


def parse_envelope(raw: DataFrame, image: T.DataType | None = None, *kept: str) -> DataFrame:
    """`value` text -> op, before, after, source, ts_ms, after the columns `kept`; images stay text unless a schema is given.

    The parsed struct is unpacked by a generator, not by field access: filters and projections that
    follow would otherwise be merged with the parse and repeat it for every field they name.
    """
    kind = schemas.envelope(image) if image is not None else schemas.envelope()
    return raw.select(*kept, F.inline(F.array(F.from_json("value", kind))))


def live_changes(events: DataFrame) -> DataFrame:
    """Events with an after image that are no deletes; `ts_ms` becomes `ts`."""
    kept = events.where(F.col("after").isNotNull() & ~F.col("op").eqNullSafe("d"))
    return kept.withColumnRenamed("ts_ms", "ts")


def place_of(source: Column) -> Column:
    """Place of an event in the database's log as sortable text; events without one are all at the same place."""
    digits = lambda c, n: F.lpad(F.coalesce(c.cast("string"), F.lit("")), n, "0")
    return F.concat(F.coalesce(source["file"], F.lit("")), F.lit(" "), digits(source["pos"], 20), digits(source["row"], 10))


def normalize(events: DataFrame, drop: tuple[str, ...] = ("source",)) -> DataFrame:
    """Hoist the source table to a column of its own and drop envelope columns."""
    return events.withColumn("table", F.col("source.table")).drop(*drop)


def of_tables(df: DataFrame, names: list[str]) -> DataFrame:
    """Events of the named tables, for raw text as well as for normalized events.

    A text that has neither a name as it is nor a backslash, by which a name could be spelled otherwise, is of another table and is not parsed.
    """
    if "table" in df.columns:
        return df.where(F.col("table").isin(list(names)))
    likely = F.col("value").contains("\\")
    for name in names:
        likely |= F.col("value").contains(name)
    # As one condition with an order: the parse comes second.
    return df.where(F.when(likely, table_of().isin(list(names))).otherwise(False))


def typed_changes(raw: DataFrame, table: str, image: T.StructType) -> DataFrame:
    """Live changes of one table with typed images. The table test runs on the text, so events of
    other tables are never parsed."""
    return live_changes(parse_envelope(of_tables(raw, [table]), image)).select("op", "before", "after", "ts")


# One schema for both kinds of image, so the log is read and parsed once.
ORDER_OR_CARGO = T.StructType(
    schemas.ORDER_INFO.fields + [f for f in schemas.ORDER_CARGO.fields if f.name not in schemas.ORDER_INFO.names])


# How fields are typed that are not on the wire as they should be.
_TYPED = {
    "order": {"create_time": S.instant_of_iso, "update_time": S.instant_of_iso, "estimate_arrive_time": S.instant_of_wall_millis},
    "cargo": {"create_time": S.instant_of_iso},
}
_FIELDS = {
    "order": [n for n in schemas.ORDER_INFO.names if n != "is_deleted"],
    "cargo": [n for n in schemas.ORDER_CARGO.names if n not in ("update_time", "is_deleted")],
}


def _image(kind: str, image: Column, fields: set[str] | None) -> Column:
    typed = _TYPED[kind]
    return F.struct(*[
        (typed[n](image[n]) if n in typed else image[n]).alias(n) for n in _FIELDS[kind] if fields is None or n in fields])


def order_changes(raw: DataFrame, fields: dict[str, set[str]] | None = None) -> DataFrame:
    """Typed changes of orders and cargo.

    Columns: order_id, tbl, op, ts (event time), before_status, order and cargo (after images; the
    one that does not apply is null), place (in the database's log, which orders changes of one instant).
    With `fields` (see `operators.order_join.wanted_fields`) the images have only these, and the parser skips all others.
    """
    schema = ORDER_OR_CARGO
    if fields is not None:
        needed = {"id", "order_id", "status"}.union(*fields.values())
        schema = T.StructType([f for f in schema.fields if f.name in needed])
    # One parse: the table test reads the parsed envelope.
    events = of_tables(normalize(live_changes(parse_envelope(raw, schema)), ()), ["order_info", "order_cargo"])
    is_order = F.col("table") == "order_info"
    wanted = fields or {"order": None, "cargo": None}
    # A generator again: filters and projections on fields of the images would otherwise be merged with what types them.
    return events.select(F.inline(F.array(F.struct(
        F.when(is_order, F.col("after.id")).otherwise(F.col("after.order_id")).alias("order_id"),
        F.col("table").alias("tbl"), "op", F.timestamp_millis("ts").alias("ts"),
        F.when(is_order, F.col("before.status")).alias("before_status"),
        F.when(is_order, _image("order", F.col("after"), wanted["order"])).alias("order"),
        F.when(~is_order, _image("cargo", F.col("after"), wanted["cargo"])).alias("cargo"), place_of(F.col("source")).alias("place")))))


def once(changes: DataFrame, within: str) -> DataFrame:
    """Events of a stream without those that a writer sent again: the first of each place in the database's log.

    `within` is how much event time may lie between a message and its repetition, and how long its place is remembered.
    """
    return changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark(["place"])


def bound_changes(raw: DataFrame) -> DataFrame:
    return typed_changes(raw, "order_org_bound", schemas.ORDER_ORG_BOUND)


def trip_changes(raw: DataFrame) -> DataFrame:
    return typed_changes(raw, "transport_task", schemas.TRANSPORT_TASK)


def dim_changes(raw: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """Dimension events: table, op, before, after (column -> value maps), ts, place. With `tables`, texts of other tables are
    not parsed into maps."""
    raw = of_tables(raw, tables) if tables else raw
    events = live_changes(parse_envelope(raw, schemas.DIM_IMAGE)).withColumn("place", place_of(F.col("source")))
    return normalize(events)


def routing_changes(raw: DataFrame, table: str = schemas.CONFIG_TABLE) -> DataFrame:
    """Events of the routing table, deletes included: op, before, after, ts, place."""
    events = parse_envelope(of_tables(raw, [table]), schemas.CONFIG_DIM).withColumn("place", place_of(F.col("source")))
    return events.withColumnRenamed("ts_ms", "ts").drop("source")
