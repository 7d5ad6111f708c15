"""Summaries whose groups follow dimensions that change while the stream runs."""

import os
import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from waybill.operators import summaries
from waybill.plans import streams
from waybill.plans.streams import as_stream, finish
from waybill.streaming import jobs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
ORGAN = "id string, org_name string, org_parent_id string, region_id string"
REGION = "id string, parent_id string, name string, dict_code string"


def organ(spark, *rows):
    return spark.createDataFrame([(i, n, None, d) for i, n, d in rows], ORGAN)


def details(spark, seed, n=160):
    r = random.Random(seed)
    rows = [(f"d{r.randrange(4)}", f"c{r.randrange(2)}", Decimal(r.randrange(1, 900)) / 100, START + timedelta(minutes=40 * i)) for i in range(n)]
    return spark.createDataFrame(rows, "sender_district_id string, sender_city_id string, amount decimal(20,2), ts timestamp")


#: Organisations at the first look, the second, and so on; the last one holds to the end.
LOOKS = {
    "arrives": [[("1", "one", "d0")], [("1", "one", "d0"), ("2", "two", "d1")], [("1", "one", "d0"), ("2", "two", "d1"), ("3", "three", "d2"), ("4", "four", "d3")]],
    "moves": [[("1", "one", "d0"), ("2", "two", "d1"), ("3", "three", "d2"), ("4", "four", "d3")], [("1", "one", "d1"), ("2", "two", "d0"), ("3", "three", "d2"), ("4", "four", "d3")]],
    "renamed and joined": [[("1", "one", "d0"), ("2", "two", "d1")], [("1", "uno", "d0"), ("2", "two", "d1"), ("0", "zero", "d1"), ("00", "x", "d1")]],
    "goes": [[("1", "one", "d0"), ("2", "two", "d1")], [("1", "one", "d0")], [("1", "one", "d0"), ("3", "three", "d1")], [("3", "three", "d1")]],
}


def run(spark, tmp_path, looks, slices, fold_every, seed=1):
    region = spark.createDataFrame([("c0", None, "C0", "City"), ("c1", None, "C1", "City")], REGION)
    seen = []

    def dims():
        seen.append(1)
        return {"base_organ": organ(spark, *looks[min(len(seen), len(looks)) - 1]), "base_region_info": region}

    facts = details(spark, seed)
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    finish(jobs.start_day_summary("org_order_day", as_stream(spark, facts, "facts", slices=slices), dims, target, checkpoint, {"availableNow": True}, fold_every=fold_every))
    assert len(seen) >= len(looks)
    got = jobs.standing(spark.read.parquet(target), "org_order_day")
    want = summaries.org_order_day(facts, organ(spark, *looks[-1]), region)
    order = lambda df: sorted((tuple(r) for r in df.select(*want.columns).collect()), key=str)
    return order(got), order(want), spark.read.parquet(target)


@pytest.mark.parametrize("name", LOOKS)
def test_newest_rows_equal_a_full_recomputation(spark, tmp_path, name):
    got, want, emitted = run(spark, tmp_path, LOOKS[name], 6, 0)
    assert got == want
    # What stood under another organisation before was taken back.
    assert emitted.where("order_count = 0").count() > 0


def test_no_null_keys_remain_when_all_districts_are_known(spark, tmp_path):
    got, want, emitted = run(spark, tmp_path, LOOKS["arrives"], 5, 2)
    assert got == want and emitted.where("org_id is null and order_count > 0").count() > 0
    assert all(row[1] is not None for row in got)


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    job = jobs.DAY_SUMMARIES["org_order_day"]
    schema = "cur_date date, district string, city_id string, first_ts timestamp, order_amount decimal(30,2), order_count bigint"
    batch = lambda *rows: spark.createDataFrame([(START.date(), d, "c", START, Decimal(n), n) for d, n in rows], schema)
    state = jobs.RebindingState(job, batch(("d", 1)).schema, str(tmp_path / "parts"), str(tmp_path / "binding"))
    binding = lambda *rows: spark.createDataFrame(list(rows), "district string, org_id string, org_name string")
    rows = lambda df: sorted(((r.org_id, r.order_count) for r in df.collect()), key=str)
    assert rows(state.apply(batch(("d", 1), ("e", 2)), binding(("d", "1", "one")), 0)) == [("1", 1), (None, 2)]
    for _ in range(2):
        assert rows(state.apply(batch(("d", 3)), binding(("d", "1", "one"), ("e", "1", "one")), 1)) == [("1", 5), (None, 0)]
    state.fold(spark, 1)
    # A group that neither the batch nor the binding touches does not come again.
    assert rows(state.apply(batch(("f", 7)), binding(("d", "1", "one"), ("e", "1", "one")), 2)) == [(None, 7)]


def test_totals_of_a_micro_batch_are_made_once_and_bound_where_plans_adapt(spark, tmp_path):
    job = jobs.DAY_SUMMARIES["org_receive_day"]
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        made.add(1)
        return value

    stream_session = spark.newSession()
    stream_session.conf.set("spark.sql.adaptive.enabled", "false")
    batch = stream_session.createDataFrame(
        [("2024-01-01", f"d{k}", "c", "p", START, k) for k in range(8)], "cur_date string, district string, city_id string, province_id string, first_ts timestamp, receive_count bigint",
    ).withColumn("district", seen("district"))
    state = jobs.RebindingState(job, batch.schema, str(tmp_path / "parts"), str(tmp_path / "binding"))
    binding = spark.createDataFrame([("d1", "1", "one"), ("d2", "1", "one")], "district string, org_id string, org_name string")
    rows = state.apply(batch, binding, 0)
    assert sorted((r.org_id or "", r.receive_count) for r in rows.collect()) == [("", 25), ("1", 3)]
    assert made.value == 8 and rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"


def test_trucks_that_come_late(spark, tmp_path):
    rows = [("o1", "Org", f"t{i % 3}", Decimal(i + 1), 60_000 * i, START + timedelta(hours=i)) for i in range(30)]
    trips = spark.createDataFrame(rows, "start_org_id string, start_org_name string, truck_id string, actual_distance decimal(20,2), transport_time bigint, ts timestamp")
    trucks = [[("t0", "m0")], [("t0", "m0"), ("t1", "m1")], [("t0", "m1"), ("t1", "m1"), ("t2", "m0")]]
    fixed = {
        "base_organ": organ(spark, ("o1", "Org", "d0")), "base_region_info": spark.createDataFrame([("d0", None, "D", "District")], REGION),
        "truck_model": spark.createDataFrame([("m0", "M0"), ("m1", "M1")], "id string, model_name string")}
    seen = []

    def dims():
        seen.append(1)
        return {**fixed, "truck_info": spark.createDataFrame(trucks[min(len(seen), 3) - 1], "id string, truck_model_id string")}

    target = str(tmp_path / "out")
    finish(jobs.start_day_summary("org_truck_model_day", as_stream(spark, trips, "trips", slices=5), dims, target, str(tmp_path / "ck"), {"availableNow": True}, fold_every=2))
    got = jobs.standing(spark.read.parquet(target), "org_truck_model_day")
    want = summaries.org_truck_model_day(trips, dims()["truck_info"], fixed["truck_model"], fixed["base_organ"], fixed["base_region_info"])
    order = lambda df: sorted((tuple(r) for r in df.select(*want.columns).collect()), key=str)
    assert order(got) == order(want)
    assert got.where(F.col("truck_model_id").isNull()).count() == 0


def test_streams_of_few_groups_have_no_more_parts_than_cores(spark, sf_dir):
    assert {name for name, job in jobs.DAY_SUMMARIES.items() if not streams.few_groups(job)} == {"bound_org_sort_day", "org_truck_model_day"}
    name, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    given, root = spark.conf.get(name), spark.conf.get("spark.checkpoint.dir", None)
    before = set(os.listdir(root)) if root else set()
    spark.conf.set(name, str(cores + 8))
    try:
        assert streams.QUERIES["stream_bound_finish_day"](spark, sf_dir).count() > 0
        assert spark.conf.get(name) == str(cores + 8)
    finally:
        spark.conf.set(name, given)
    root = spark.conf.get("spark.checkpoint.dir")
    [state] = [f"{root}/{d}/checkpoint/state/0" for d in set(os.listdir(root)) - before if d.startswith("waybill-bound_finish_day-")]
    assert len([d for d in os.listdir(state) if d.isdigit()]) == cores
