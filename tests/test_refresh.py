"""Routing as of the event, tables from routing rows, and names refreshed by changed keys."""

import json
import uuid

import pytest

from waybill import schemas
from waybill.operators import refresh, routing
from waybill.plans.streams import as_stream, finish
from waybill.sources import changes, topics
from waybill.streaming import dims


def event(table, ts, op="u", pos=0, **images):
    return {"op": op, "source": {"table": table, "file": "f", "pos": pos, "row": 0}, "ts_ms": ts, **images}


def route(op, ts, columns="id,name", table="a", pos=0):
    row = {"source_table": table, "sink_table": f"dim_{table}", "sink_columns": columns, "sink_pk": "id"}
    return event(schemas.CONFIG_TABLE, ts, op, pos, **({"before": row} if op == "d" else {"after": row}))


def raw(spark, events):
    return spark.createDataFrame([(json.dumps(e), e["ts_ms"]) for e in events], "value string, at long")


LOG = [
    event("a", 1, after={"id": "early"}), route("c", 2, pos=5), event("a", 2, pos=4, after={"id": "same time, before"}), event("a", 2, pos=6, after={"id": "same time, after", "name": "n"}),
    route("u", 5, "id"), event("a", 6, after={"id": "narrow", "name": "gone"}), route("d", 8), event("a", 9, after={"id": "removed"}),
    route("c", 10), event("a", 11, after={"id": "back", "name": "m"}), event("b", 12, after={"id": "unrouted"})]
ROUTED = [("back", {"id": "back", "name": "m"}), ("narrow", {"id": "narrow"}), ("same time, after", {"id": "same time, after", "name": "n"})]


def test_routing_as_of_the_event(spark):
    log = raw(spark, LOG)
    versions = routing.routing_versions(changes.routing_changes(log))
    routed = routing.route_dims_as_of(changes.dim_changes(log), versions)
    assert sorted((r.row_key, r.columns) for r in routed.collect()) == ROUTED
    loaded = spark.createDataFrame([("b", "dim_b", None, "id", "id", None), ("a", "dim_old", None, "id", "id", None)], schemas.CONFIG_DIM)
    with_scan = routing.route_dims_as_of(changes.dim_changes(log), versions.unionByName(routing.loaded_versions(loaded)))
    assert sorted((r.sink_table, r.row_key) for r in with_scan.collect() if r.row_key in ("early", "unrouted", "same time, before")) == [
        ("dim_b", "unrouted"), ("dim_old", "early"), ("dim_old", "same time, before")]


@pytest.mark.parametrize("slices", [1, 4, 11])
def test_tables_from_routing_rows_in_any_batching(spark, tmp_path, slices):
    stream = as_stream(spark, raw(spark, LOG), "routing", ["at", "value"], slices).select("value")
    none = spark.createDataFrame([], schemas.CONFIG_DIM)
    prefix = f"x{uuid.uuid4().hex}_"
    finish(dims.start_dim_tables(stream, none, lambda sink: prefix + sink, str(tmp_path), str(tmp_path / "ck"), {"availableNow": True}))
    table = spark.table(f"{prefix}dim_a")
    # The table has the columns of the routing row that made it; in one batch that is the newest one.
    assert sorted(r.id for r in table.collect()) == [k for k, _ in ROUTED]
    assert {r.id: r.name for r in table.collect()}["back"] == "m"
    assert not spark.catalog.tableExists(f"{prefix}dim_b")
    spark.sql(f"DROP TABLE {prefix}dim_a")


def test_only_rows_that_show_a_change_come_again(spark):
    rows = spark.createDataFrame(
        [("o1", "c1", "p1"), ("o2", "c1", "p1"), ("o3", "c2", "p1"), ("o4", "c3", "p2"), ("o5", None, None)], "org_id string, city_id string, province_id string")
    changed = spark.createDataFrame([("dim_base_organ", "o3"), ("dim_base_organ", "hub"), ("dim_base_region_info", "p2"), ("dim_base_dic", "o1")], "sink_table string, id string")
    organ = spark.createDataFrame([("o1", "hub"), ("o2", "other"), ("hub", None)], "id string, org_parent_id string")
    hit = refresh.rows_showing(rows, refresh.with_children(changed, organ), refresh.SHOWS["bound_org_sort_day"])
    assert sorted(r.org_id for r in hit.collect()) == ["o1", "o3", "o4"]


def test_changed_rows_are_updates_only(spark):
    log = raw(spark, [event("a", 1, "c", after={"id": "new"}), event("a", 2, before={"id": "1"}, after={"id": "1"}), event("a", 3, before={"id": "1"}, after={"id": "1"})])
    config = spark.createDataFrame([("a", "dim_a", None, "id", "id", None)], schemas.CONFIG_DIM)
    routed = routing.route_dims(changes.dim_changes(log), config)
    assert [tuple(r) for r in refresh.changed_rows(routed).collect()] == [("dim_a", "1")]


def test_messages_sent_again_count_once(spark, tmp_path):
    """Repeated in the same and in a later micro-batch; equal events at two places are two."""
    topic, out = str(tmp_path / "topic"), str(tmp_path / "out")
    cargo = lambda pos, ts: event("order_cargo", ts, "c", pos, after={"id": "c", "order_id": "1"})
    parts = [[cargo(1, 1000), cargo(2, 1000), cargo(1, 1000)], [cargo(2, 1000), cargo(3, 2000)], [cargo(1, 1000), cargo(3, 2000), cargo(4, 9000)]]
    for part in parts:
        topics.write_topic(spark.read.json(spark.sparkContext.parallelize([json.dumps(e) for e in part], 1)), topic, "text")
        once = changes.once(changes.order_changes(changes.read_changes(spark, topic, "dwd")), "1 hour")
        finish(once.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out))
    assert sorted(int(r.place.split()[1][:20]) for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]
