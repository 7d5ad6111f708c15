import json
import os

import pytest

from waybill.operators import facts
from waybill.operators.order_join import relevant, wanted_fields
from waybill.plans import standins
from waybill.sources import changes, tables, topics


def envelope(op="c", table="order_info", ts=1, **images):
    return json.dumps({"op": op, "source": {"table": table}, "ts_ms": ts, "transaction": None, **images})


@pytest.fixture
def log(spark, tmp_path):
    lines = [envelope(after={"id": "1"}, ts=10), envelope("d", before={"id": "1"}, ts=20), envelope("u", ts=30),
             envelope("r", "user_info", after={"id": "7"}, ts=5), envelope("c", "unlisted", after={"id": "8"}), ""]
    path = str(tmp_path / "log")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_empty_payload_is_null(spark, log):
    values = [r.value for r in topics.read_topic(spark, log, "text", streaming=False).collect()]
    assert values.count(None) == 1 and len(values) == 6


def test_groups_and_start(spark, log):
    initial = changes.read_changes(spark, log, "realtime-dim", streaming=False)
    assert initial.count() == 1
    assert changes.read_changes(spark, log, "dwd", streaming=False, since_ms=20).count() == 2
    assert changes.read_changes(spark, log, "dwd", streaming=False).count() == 3
    assert changes.read_changes(spark, log, "dwd", "initial", streaming=False).count() == 3
    with pytest.raises(ValueError):
        changes.read_changes(spark, log, "nothing")


def test_live_changes(spark, log):
    events = changes.parse_envelope(topics.read_topic(spark, log, "text", streaming=False))
    live = changes.normalize(changes.live_changes(events))
    assert set(live.columns) == {"op", "before", "after", "ts", "table"}
    assert sorted(r.table for r in live.collect()) == ["order_info", "unlisted", "user_info"]
    assert changes.of_tables(live, ["user_info"]).count() == 1


def test_missing_op_counts_as_live(spark):
    raw = spark.createDataFrame([(json.dumps({"after": {"id": "1"}, "source": {"table": "t"}}),), ("not json",)], "value string")
    assert changes.live_changes(changes.parse_envelope(raw)).count() == 1


def test_topic_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", None), ("2", "x")], "id string, name string")
    topics.write_topic(rows, str(tmp_path / "t"), "text")
    values = {r.value for r in topics.read_topic(spark, str(tmp_path / "t"), "text", streaming=False).collect()}
    assert values == {'{"id":"1"}', '{"id":"2","name":"x"}'}
    stream = topics.read_topic(spark, str(tmp_path / "t"), "text")
    query = topics.write_topic(stream, str(tmp_path / "u"), "text", str(tmp_path / "ck"), trigger={"availableNow": True})
    query.awaitTermination()
    assert spark.read.text(str(tmp_path / "u")).count() == 2
    with pytest.raises(ValueError):
        topics.write_topic(rows, "", "text")


def test_messages_carry_a_key(spark):
    rows = spark.createDataFrame([(1, "x")], "id int, name string")
    assert topics.as_messages(rows, "id").first().asDict() == {"key": "1", "value": '{"id":1,"name":"x"}'}


def test_write_summary(spark, tmp_path):
    df = spark.createDataFrame([(1, "helper", 2)], "b int, join_org_id string, a int")
    for _ in range(2):
        tables.write_summary(df, str(tmp_path / "s"), ["a", "b"], batch_id=3)
    rows = spark.read.parquet(str(tmp_path / "s"))
    assert rows.columns == ["a", "b", "batch_id"] and rows.count() == 1
    tables.write_summary(df, str(tmp_path / "p"), ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["a", "b"]
    assert tables.read_config(spark, str(tmp_path / "p")).count() == 1


def test_changes_as_a_stream(spark, log, tmp_path):
    stream = changes.live_changes(changes.parse_envelope(changes.read_changes(spark, log, "realtime-dim")))
    writer = stream.select("op", "after", "ts").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("r", '{"id":"7"}', 5)]


def test_events_written_while_a_job_is_down_come_out_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def write(*ids):
        lines = [(envelope(after={"id": i}, ts=1),) for i in ids]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(source)

    def run():
        raw = changes.read_changes(spark, source, "dwd")
        raw.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()

    write("1")
    run()
    write("2", "3")
    run()
    run()
    events = changes.parse_envelope(spark.read.parquet(target))
    assert sorted(json.loads(r.after)["id"] for r in events.collect()) == ["1", "2", "3"]


def test_texts_of_other_tables_are_told_without_a_parse(spark):
    """A table's name may be spelled with escapes, or stand elsewhere in the text."""
    def event(table, note=""):
        return '{"op":"c","after":{"note":"%s"},"source":{"table":"%s"}}' % (note, table)

    texts = [event("order_cargo"), event("order_\\u0063argo"), event("order_info"), event("order_info", "order_cargo"), event("x", "a\\\\b"), None, "{"]
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    kept = changes.of_tables(raw, ["order_cargo"])
    assert sorted(r.value for r in kept.collect()) == sorted(texts[:2])
    assert "contains" in kept._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_filter_on_an_image_reads_the_image_that_was_made(spark, sf_dir):
    log = relevant(changes.order_changes(standins.order_log(spark, sf_dir).select("value"), wanted_fields(["order_id", "amount"])))
    plan = log._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [line for line in plan if "Filter" in line and "order_id" in line and "tbl" in line]
    assert filters and not any("after" in line for line in filters)


def test_parts_of_the_orders_grow_with_the_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(standins, "MOST_BYTES", {"orders": 2_000})
    standins._SEEN.clear()
    size = os.path.getsize(f"{sf_dir}/orders.parquet")
    assert standins.table(spark, sf_dir, "orders").rdd.getNumPartitions() == -(-size // 2_000) > spark.sparkContext.defaultParallelism


def test_parts_of_the_customers_grow_with_the_table(spark, sf_dir, monkeypatch):
    """Only as far as their bytes ask for it, and not where they are joined."""
    standins._SEEN.clear()
    assert standins.table(spark, sf_dir, "customer").rdd.getNumPartitions() == 1
    monkeypatch.setattr(standins, "MOST_BYTES", {"customer": 1_000})
    size = os.path.getsize(f"{sf_dir}/customer.parquet")
    assert standins.table(spark, sf_dir, "customer").rdd.getNumPartitions() == -(-size // 1_000) > 1
    assert standins.table(spark, sf_dir, "customer", spread=False).rdd.getNumPartitions() == 1


def test_narrow_bounds_make_the_same_steps(spark, sf_dir):
    whole = standins.bound_changes(spark, sf_dir)
    narrow = facts.narrow_bounds(whole)
    assert narrow.schema["before"].dataType.names == ["sort_time", "outbound_time"]
    assert facts.bound_steps(narrow).exceptAll(facts.bound_steps(whole)).isEmpty()
    assert facts.bound_steps(whole).exceptAll(facts.bound_steps(narrow)).isEmpty()
