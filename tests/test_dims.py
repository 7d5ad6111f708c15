import json

import pytest
from pyspark.sql import functions as F

from waybill import schemas
from waybill.functions.scalars import csv_items
from waybill.operators import lookups, routing
from waybill.sources import changes, tables
from waybill.streaming import dims


def raw(spark, *events):
    return spark.createDataFrame([(json.dumps(e),) for e in events], "value string")


def config_event(op, table, sink, ts, before=False):
    row = {"source_table": table, "sink_table": sink, "sink_columns": "id,name", "sink_pk": "id", "foreign_keys": ""}
    images = {"before": row} if before else {"after": row}
    return {"op": op, **images, "source": {"table": schemas.CONFIG_TABLE}, "ts_ms": ts}


CONFIG = "source_table string, sink_table string, sink_family string, sink_columns string, sink_pk string, foreign_keys string"


def test_config_changes(spark):
    log = raw(spark, config_event("r", "a", "dim_a", 1), config_event("u", "a", "dim_a2", 2),
              config_event("c", "b", "dim_b", 3), config_event("d", "b", "dim_b", 4, before=True))
    loaded = spark.createDataFrame([("a", "old_a", None, "id", "id", None), ("c", "dim_c", None, "id", "id", None)], CONFIG)
    rows = routing.config_latest(changes.routing_changes(log), loaded).collect()
    assert {r.source_table: r.sink_table for r in rows} == {"a": "dim_a2", "c": "dim_c"}


def test_routing_passes_only_configured_tables(spark):
    log = raw(
        spark,
        {"op": "u", "before": {"id": "1", "name": "x", "fk": "7"}, "after": {"id": "1", "name": "y", "fk": "8", "junk": "z"},
         "source": {"table": "a"}, "ts_ms": 5},
        {"op": "c", "after": {"id": "2", "name": "n"}, "source": {"table": "unknown"}, "ts_ms": 6},
        {"op": "d", "before": {"id": "3"}, "source": {"table": "a"}, "ts_ms": 7})
    config = spark.createDataFrame([("a", "dim_a", "", "id,name,fk", "id", "fk")], CONFIG)
    (row,) = routing.route_dims(changes.dim_changes(log), config).collect()
    assert (row.sink_table, row.sink_pk, row.sink_family, row.row_key) == ("dim_a", "id", "info", "1")
    assert row.columns == {"id": "1", "name": "y", "fk": "8"}
    assert [tuple(p) for p in row.changed] == [("id", "1"), ("fk", "7")]


def test_upsert_is_latest_wins_and_repeatable(spark, tmp_path):
    path, schema = str(tmp_path / "dim"), "id string, name string, seq bigint"
    first = spark.createDataFrame([("1", "a", 1), ("2", "b", 1), ("1", "a2", 3)], schema)
    second = spark.createDataFrame([("2", "b2", 2), ("1", "stale", 2), ("3", "c", 2)], schema)
    tables.upsert_dim(first, path, ["id", "name"], 0)
    for _ in range(2):
        tables.upsert_dim(second, path, ["id", "name"], 1)
    want = {("1", "a2"), ("2", "b2"), ("3", "c")}
    assert {tuple(r) for r in tables.read_dim(spark, path, "id").collect()} == want
    compacted = str(tmp_path / "compacted")
    tables.compact_dim(spark, path, compacted, "id")
    assert spark.read.parquet(compacted).count() == 3
    tables.upsert_dim(spark.createDataFrame([("3", "c2", 9)], schema), compacted, ["id", "name"], 2)
    assert {tuple(r) for r in tables.read_dim(spark, compacted, "id").collect()} == {("1", "a2"), ("2", "b2"), ("3", "c2")}


def test_ensure_dim(spark, tmp_path):
    location = str(tmp_path / "t")
    for _ in range(2):
        tables.ensure_dim(spark, "dim_test", "id,name", location)
    assert spark.table("dim_test").columns == ["id", "name", "seq", "batch_id"]
    spark.sql("DROP TABLE dim_test")


def test_stored_dims(spark, tmp_path):
    log = raw(spark, {"op": "c", "after": {"id": "1", "name": "x"}, "source": {"table": "a"}, "ts_ms": 5},
              {"op": "u", "before": {"id": "1"}, "after": {"id": "1", "name": "y"}, "source": {"table": "a"}, "ts_ms": 6})
    config = spark.createDataFrame([("a", "dim_a", None, "id,name", "id", None)], CONFIG)
    routed = routing.route_dims(changes.dim_changes(log), config)
    for _ in range(2):
        dims.store_dims(routed, str(tmp_path), 0)
    assert [tuple(r) for r in dims.current_dim(spark, str(tmp_path), "dim_a", ["id", "name"]).collect()] == [("1", "y")]


def test_lookup_first_uses_text_order_and_keeps_misses(spark):
    dim = spark.createDataFrame([("9", "d1", "nine"), ("10", "d1", "ten"), ("1", None, "none")], "id string, region_id string, org_name string")
    df = spark.createDataFrame([("d1",), ("d2",), (None,)], "district string")
    rows = lookups.lookup_first(df, dim, "district", "region_id", {"id": "org_id", "org_name": "org_name"}).collect()
    assert {tuple(r) for r in rows} == {("d1", "10", "ten"), ("d2", None, None), (None, None, None)}


def test_org_city_misses(spark):
    organ = spark.createDataFrame(
        [("1", "station", "9", "d1"), ("9", "hub", None, "c1"), ("2", "orphan", "8", "d2")],
        "id string, org_name string, org_parent_id string, region_id string")
    df = spark.createDataFrame([("1",), ("9",), ("2",), ("404",)], "org_id string")
    rows = {r.org_id: (r.org_name, r.city_id) for r in lookups.org_city(df, organ).collect()}
    assert rows == {"1": ("station", "c1"), "9": ("hub", "c1"), "2": ("orphan", None), "404": (None, None)}


def test_org_city_of_ids_that_a_hub_and_a_station_share(spark):
    """A row stays one row, and its city is the region of the hub, however the dimension's rows are dealt."""
    rows = [("9", "hub", None, "100"), ("9", "s9", "8", "2009"), ("8", "other hub", None, "101"), ("1", "s1", "9", "2001")]
    df = spark.createDataFrame([("1", 7), ("9", 8)], "org_id string, n int")
    for organ in (rows, rows[::-1]):
        organ = spark.createDataFrame(organ, "id string, org_name string, org_parent_id string, region_id string")
        found = lookups.org_city(df, organ).select("org_id", "n", "org_name", "city_id").collect()
        assert sorted(tuple(r) for r in found) == [("1", 7, "s1", "100"), ("9", 8, "hub", "100")]



def test_city_province_only_for_cities(spark):
    region = spark.createDataFrame(
        [("p", None, "P", "Province"), ("c", "p", "C", "City"), ("d", "c", "D", "District")],
        "id string, parent_id string, name string, dict_code string")
    df = spark.createDataFrame([("c",), ("d",), ("x",)], "city_id string")
    rows = {r.city_id: (r.city_name, r.province_id, r.province_name) for r in lookups.city_province(df, region).collect()}
    assert rows == {"c": ("C", "p", "P"), "d": ("D", None, None), "x": (None, None, None)}


def test_keep_columns(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},)], "m map<string,string>")
    assert df.select(routing.keep_columns(F.col("m"), csv_items(F.lit("b,c")))).first()[0] == {"b": "2"}


@pytest.mark.parametrize("turned", [False, True])
def test_of_two_changes_in_one_millisecond_the_later_in_the_log_wins(spark, tmp_path, turned):
    from waybill.operators.order_join import join_orders_batch
    from waybill.sources import changes
    from waybill.streaming import dims

    def event(table, pos, op="u", **images):
        return json.dumps({"op": op, "source": {"table": table, "file": "log.000009", "pos": pos}, "ts_ms": 5, **images})

    rows = [event("base_dic", 90, after={"id": "1", "name": "old"}), event("base_dic", 1000, after={"id": "1", "name": "new"})]
    config = spark.createDataFrame([("base_dic", "dim_dic", None, "id,name", "id", None)], schemas.CONFIG_DIM)
    raw = spark.createDataFrame([(x,) for x in (rows[::-1] if turned else rows)], "value string")
    for i in (0, 1):
        one = raw.limit(1) if i == 0 else raw.exceptAll(raw.limit(1))
        dims.store_dims(routing.route_dims(changes.dim_changes(one), config), str(tmp_path / "dims"), i)
    assert dims.current_dim(spark, str(tmp_path / "dims"), "dim_dic", ["id", "name"]).first().name == "new"

    # The cancel comes after the cargo in the log, so it finds it, although its table sorts later.
    log = [
        event("order_cargo", 10, "c", after={"id": "c", "order_id": "7"}),
        event("order_info", 20, before={"status": "60020"}, after={"id": "7", "status": "60999"}),
        event("order_cargo", 30, "c", after={"id": "d", "order_id": "7"})]
    raw = spark.createDataFrame([(x,) for x in (log[::-1] if turned else log)], "value string")
    facts = join_orders_batch(changes.order_changes(raw)).collect()
    assert [(f.fact, f.cargo.id) for f in facts] == [("cancel", "c")]
