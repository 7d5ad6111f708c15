import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from simulation import simulate

from waybill.operators import skew
from waybill.operators.order_join import SEQUENCE, join_orders_batch, relevant
from waybill.plans import standins
from waybill.plans.streams import as_stream, end_marker, finish
from waybill.session import shared_dir
from waybill.streaming.order_join import join_orders

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = """order_id string, tbl string, op string, ts timestamp, before_status string,
  `order` struct<id: string, status: string, update_time: timestamp, amount: decimal(20,2)>,
  cargo struct<id: string, order_id: string, create_time: timestamp>"""


def changes(spark, rows):
    def typed(row):
        oid, tbl, op, ms, s0, s1, cargo = row
        at = START + timedelta(milliseconds=ms)
        if tbl == "order_cargo":
            return oid, tbl, op, at, None, None, (cargo, oid, at)
        return oid, tbl, op, at, s0, (oid, s1, at, None), None

    return spark.createDataFrame([typed(r) for r in rows], SCHEMA)


def result(joined):
    rows = joined.select(
        F.coalesce("order.id", "cargo.order_id").alias("oid"), "fact", "cargo.id", "order.status",
        (F.unix_millis("order.update_time") - int(START.timestamp() * 1000)).alias("ms")).collect()
    return sorted(tuple(r) for r in rows)


def order(oid, op, ms, s0=None, s1="60010"):
    return oid, "order_info", op, ms, s0, s1, None


def cargo(oid, ms, cid, op="c"):
    return oid, "order_cargo", op, ms, None, None, cid


EDGES = {
    "cargo first": [cargo("a", 0, "c1"), order("a", "c", 1)],
    "order first, in time": [order("a", "c", 0), cargo("a", 4999, "c1")],
    "order first, too late": [order("a", "c", 0), cargo("a", 5000, "c1"), order("a", "u", 6000, "60010", "60020")],
    "order first, two cargo rows": [order("a", "c", 0), cargo("a", 1, "c1"), cargo("a", 2, "c2")],
    "latest cargo wins": [cargo("a", 0, "c1"), cargo("a", 1, "c2"), order("a", "c", 2)],
    "cargo update refreshes": [cargo("a", 0, "c1"), order("a", "c", 1), cargo("a", 9000, "c1b", "u"), order("a", "u", 9001, "60010", "60020")],
    "update before cargo is lost": [order("a", "c", 0), order("a", "u", 10, "60010", "60020"), cargo("a", 20, "c1")],
    "snapshot read of an order is ignored": [cargo("a", 0, "c1"), order("a", "r", 1), order("a", "u", 2, "60010", "60020")],
    "cancel clears cargo": [cargo("a", 0, "c1"), order("a", "c", 1), order("a", "u", 2, "60020", "60999"), order("a", "u", 3, "60010", "60020")],
    "cargo after cancel": [cargo("a", 0, "c1"), order("a", "u", 2, "60020", "60999"), cargo("a", 3, "c2"), order("a", "u", 4, "60020", "60030")],
    "signing clears cargo": [cargo("a", 0, "c1"), order("a", "u", 1, "60070", "60080"), order("a", "u", 2, "60080", "60999")],
    "dropped transition": [cargo("a", 0, "c1"), order("a", "u", 1, "60030", "60040"), order("a", "u", 2, "60040", "60050")],
    "created again": [order("a", "c", 0), order("a", "c", 4000), cargo("a", 8000, "c1")],
    "no order id": [(None, "order_cargo", "c", 0, None, None, "c1"), (None, "order_info", "c", 1, None, "60010", None)],
}


@pytest.mark.parametrize("name", EDGES)
def test_edges(spark, name):
    assert result(join_orders_batch(changes(spark, EDGES[name]))) == sorted(simulate(EDGES[name]))


def test_kept_cargo_after_signing_is_an_option(spark):
    rows = EDGES["signing clears cargo"]
    joined = join_orders_batch(changes(spark, rows), clear_on=("cancel",))
    assert result(joined) == sorted(simulate(rows, clear_on=("cancel",)))


def random_log(seed, orders=30, events=600, hot=0):
    rng = random.Random(seed)
    codes = ["60010", "60020", "60030", "60040", "60050", "60060", "60070", "60080", "60999"]
    rows = []
    for i in range(events):
        oid = "hot" if rng.random() < hot else f"o{rng.randrange(orders)}"
        ms = rng.randrange(60_000)
        kind = rng.random()
        if kind < 0.25:
            rows.append(cargo(oid, ms, f"c{i}", rng.choice("cu")))
        elif kind < 0.45:
            rows.append(order(oid, "c", ms))
        else:
            step = rng.randrange(8)
            new = "60999" if rng.random() < 0.1 else codes[step + 1]
            rows.append(order(oid, rng.choice("uuuur"), ms, codes[step], new))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    rows = random_log(seed)
    assert result(join_orders_batch(changes(spark, rows))) == sorted(simulate(rows))


@pytest.mark.parametrize("fact", ["detail", "deliver", "cancel", "sign"])
def test_one_fact_alone(spark, fact):
    """The same rows as among all facts, in slices too, from a part of the log."""
    rows = random_log(11, hot=0.3)
    log = changes(spark, rows)
    expected = sorted(r for r in simulate(rows) if r[1] == fact)
    assert expected and result(join_orders_batch(log, fact=fact)) == expected
    assert result(join_orders_batch(log, fact=fact, max_rows=20, slices=7)) == expected
    kept = {r._status for r in relevant(log, fact).select("_status").distinct().collect()}
    assert kept == {None, "cancel", "sign", *([] if fact == "detail" else [fact])}
    assert relevant(log, fact).count() < relevant(log).count()


@pytest.mark.parametrize("slices", [2, 25, None])
def test_hot_order_in_slices(spark, slices):
    rows = random_log(7, hot=0.4)
    log = changes(spark, rows)
    assert [r.order_id for r in skew.hot_keys(log, "order_id", 50).collect()] == ["hot"]
    assert result(join_orders_batch(log, max_rows=50, slices=slices)) == sorted(simulate(rows))


def test_every_order_in_slices(spark):
    rows = random_log(5)
    assert result(join_orders_batch(changes(spark, rows), max_rows=0, slices=40)) == sorted(simulate(rows))


def test_more_than_a_thousand_hot_orders(spark):
    rows = random_log(6, orders=1500, events=9000)
    log = changes(spark, rows)
    assert skew.hot_keys(log, "order_id", 1).count() > 1000
    assert result(join_orders_batch(log, max_rows=1, slices=9)) == sorted(simulate(rows))


@pytest.mark.parametrize("hot, slices", [(0.0, 9), (0.4, 25)])
def test_many_hot_orders_are_not_told_from_others_by_a_join(spark, monkeypatch, hot, slices):
    """All rows go into slices then, and the carry reads only the keys that a slice begins or ends with."""
    monkeypatch.setattr(skew, "FEW", 3)
    rows = random_log(17, orders=200, events=1500, hot=hot)
    joined = join_orders_batch(changes(spark, rows), max_rows=1, slices=slices)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan
    assert all("hot-rows" in f for f in joined.inputFiles())
    assert result(joined) == sorted(simulate(rows))


def test_slice_ends(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("c", 1), ("d", 2), ("e", 2), ("f", 2)], f"k string, {skew.SLICE} int")
    assert skew.slice_ends(rows, "k") == ["a", "c", "d", "f"]


def test_slices_share_the_rows(spark):
    log = changes(spark, random_log(7, events=2000, hot=0.5)).where("order_id = 'hot'")
    sizes = [r["count"] for r in skew.slice_rows(log, "order_id", ["ts"], 10).groupBy(skew.SLICE).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 300


def test_rows_of_one_instant_are_sliced(spark):
    rows = [cargo("hot", 0, f"c{i:02d}") for i in range(40)] + [order("hot", "c", 0)]
    log = changes(spark, rows)
    sizes = [r["count"] for r in skew.slice_rows(log, "order_id", ["ts", "cargo.id"], 4).groupBy(skew.SLICE).count().collect()]
    assert max(sizes) < 20
    assert result(join_orders_batch(log, max_rows=9, slices=4)) == sorted(simulate(rows))


@pytest.mark.parametrize("slices", [1, 6])
def test_stream_equals_batch(spark, slices):
    rows = random_log(11, events=500)
    root = shared_dir(spark, "test-join")
    # Facts wait for the watermark, so a row without a waybill comes last.
    log = changes(spark, rows)
    stream = as_stream(spark, log, "test-log", SEQUENCE, slices, end_marker(log, tbl="order_cargo"))
    query = join_orders(stream).writeStream.format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    finish(query)
    assert len([p for p in query.recentProgress if p.numInputRows]) == slices + 1
    assert result(spark.read.parquet(f"{root}/out")) == sorted(simulate(rows))


def test_finish_raises_the_stream_error(spark, tmp_path):
    spark.createDataFrame([("x",)], "value string").write.parquet(str(tmp_path / "in"))

    def fail(batch, batch_id):
        raise ValueError("boom")

    stream = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="boom"):
        finish(query)


@pytest.mark.parametrize("seed, bucket", [(12, 1), (13, 60_000)])
def test_stream_over_files_out_of_order(spark, seed, bucket):
    """Files turned round in time, rows of one waybill in many of them; buckets of one millisecond and of the whole log."""
    rows = random_log(seed, events=400, hot=0.3)
    log = changes(spark, rows)
    root = shared_dir(spark, "test-unordered")
    marker = end_marker(log, tbl="order_cargo")
    stream = as_stream(spark, log, "test-log", SEQUENCE, 6, marker, lambda n: [2, 0, 1, 5, 3, 4])
    joined = join_orders(stream, delay="60 seconds", bucket_ms=bucket)
    query = joined.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    finish(query)
    assert result(spark.read.parquet(f"{root}/out")) == sorted(simulate(rows))


def test_many_waybills_share_the_values_of_the_state(spark):
    """What waits and what is held lies in a few values a part, so a micro-batch's calls to the state do not grow with the waybills. Rows of another waybill that
    are behind the watermark are taken when they come."""
    rows = random_log(18, orders=300, events=1500)
    late = [cargo("late", 5, "c"), order("late", "c", 6), order("late", "u", 7, "60010", "60020"), order("late", "u", 8, "60070", "60080")]
    log = changes(spark, rows)
    root = shared_dir(spark, "test-parts")
    stream = as_stream(spark, log, "test-log", SEQUENCE, 6, end_marker(log, tbl="order_cargo").unionByName(changes(spark, late)))
    query = join_orders(stream, parts=3, bucket_ms=1000).writeStream.format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    finish(query)
    assert result(spark.read.parquet(f"{root}/out")) == sorted(simulate(rows + late))
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 40


def test_the_log_is_read_once(spark, tmp_path):
    """What the facts are read from afterwards is the written table, and building them starts one job over the log."""
    log = changes(spark, random_log(14))
    log.write.parquet(str(tmp_path / "log"))
    joined = join_orders_batch(spark.read.parquet(str(tmp_path / "log")))
    assert not any("/log/" in f for f in joined.inputFiles()) and all("keyed-rows" in f for f in joined.inputFiles())


@pytest.mark.parametrize("max_rows, named", [(10, True), (150, True), (260, False), (10_000, False)])
def test_hot_orders_are_found_while_the_rows_are_written(spark, max_rows, named):
    rows = random_log(15, events=900, hot=0.25)
    log = changes(spark, rows)
    table, hot = skew.written_once(log, "order_id", max_rows)
    counts = {r.order_id: r["count"] for r in log.groupBy("order_id").count().collect()}
    assert table.count() == 900
    assert sorted(r.order_id for r in hot.collect()) == sorted(k for k, n in counts.items() if n > max_rows) if hot is not None else max(counts.values()) <= max_rows
    assert named == (hot is not None and not hot.isEmpty())


def test_many_rows_are_counted_where_the_summary_cannot_tell(spark, monkeypatch):
    monkeypatch.setattr(skew, "TOLD_APART", 1.0)
    rows = random_log(16, events=300, hot=0.5)
    _, hot = skew.written_once(changes(spark, rows), "order_id", 50)
    assert [r.order_id for r in hot.collect()] == ["hot"]


def test_clearing_rules_show_in_the_hard_cases(spark, sf_dir):
    """With cargo kept after cancel or signing the facts of the registered query would be others."""
    log = standins.hard_changes(spark, sf_dir)
    facts = {name: join_orders_batch(log, clear_on=on).count() for name, on in (("both", ("cancel", "sign")), ("none", ()), ("cancel", ("cancel",)))}
    assert facts["both"] < facts["cancel"] < facts["none"]
