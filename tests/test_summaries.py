from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from waybill.operators import facts, reports, snapshots, summaries
from waybill.session import shared_dir
from waybill.streaming import events, fanout


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


ORGAN = [("1", "one", "9", "d1"), ("9", "hub", None, "c1")]
REGION = [("c1", "p1", "City1", "City"), ("c2", "p1", "City2", "City"), ("p1", None, "P1", "Province")]


@pytest.fixture(scope="module")
def dims(spark):
    return (spark.createDataFrame(ORGAN, "id string, org_name string, org_parent_id string, region_id string"),
            spark.createDataFrame(REGION, "id string, parent_id string, name string, dict_code string"))


def detail(spark, rows):
    return spark.createDataFrame(rows, "sender_district_id string, sender_city_id string, amount decimal(20,2), ts timestamp")


DETAIL = [
    ("d1", "c2", Decimal("1.10"), at("2024-01-01 10:00:00")),
    ("d1", "c1", Decimal("2.20"), at("2024-01-01 09:00:00")),
    ("d1", "c1", Decimal("4.00"), at("2024-01-01 16:00:00")),
    ("dx", "c1", Decimal("8.00"), at("2024-01-01 15:59:59")),
]
DAYS = {
    (date(2024, 1, 1), "1", "one", "c1", "City1", Decimal("3.30"), 2),
    (date(2024, 1, 2), "1", "one", "c1", "City1", Decimal("4.00"), 1),
    (date(2024, 1, 1), None, None, "c1", "City1", Decimal("8.00"), 1),
}


def test_org_order_day(spark, dims):
    assert {tuple(r) for r in summaries.org_order_day(detail(spark, DETAIL), *dims).collect()} == DAYS


def test_bound_facts_one_update_gives_two(spark):
    image = "struct<id: string, order_id: string, org_id: string, inbound_time: string, inbound_emp_id: string, sort_time: string, sorter_emp_id: string, outbound_time: string, outbound_emp_id: string>"
    before = ("1", "o", "g", "28800000", "e", None, None, None, None)
    after = ("1", "o", "g", "28800000", "e", "28801000", "s", "28802000", "u")
    log = spark.createDataFrame([("c", None, before), ("u", before, after), ("u", after, after), ("r", None, after)],
                                f"op string, before {image}, after {image}")
    split = {name: [r[0] for r in df.select(F.unix_millis("ts")).collect()] for name, df in facts.bound_facts(log).items()}
    assert split == {"inbound": [0], "sort": [1000], "outbound": [2000]}
    steps = facts.bound_steps(log).select("fact", "emp_id", F.unix_millis("ts")).collect()
    assert sorted(tuple(r) for r in steps) == [("inbound", "e", 0), ("outbound", "u", 2000), ("sort", "s", 1000)]


def test_trip_finish(spark):
    image = "struct<id: string, driver1_name: string, driver2_name: string, truck_no: string, actual_start_time: string, actual_end_time: string>"
    start, end = ("1", "Li Si", None, "A-1", "28800000", None), ("1", "Li Si", None, "A-1", "28800000", "28860000")
    log = spark.createDataFrame([("c", None, start), ("u", start, end), ("u", end, end), ("u", start, start), ("u", None, end)],
                                f"op string, before {image}, after {image}")
    (row,) = facts.trip_finish(log).collect()
    assert (row.driver1_name, row.driver2_name, row.transport_time) == ("L****", None, 60000)


def test_snapshots_end_at_the_day_total(spark):
    rows = spark.createDataFrame(
        [("a", at(f"2024-01-01 10:00:{s:02d}"), s) for s in (1, 2, 9, 10, 25)] + [("b", at("2024-01-01 16:00:00"), 7)],
        "k string, ts timestamp, v int")
    series = snapshots.cumulative_snapshots(rows, ["k"], {"v": F.sum("v")})
    got = sorted((r.k, r.version.second, r.v) for r in series.collect())
    assert got == [("a", 10, 12), ("a", 20, 22), ("a", 30, 47), ("b", 10, 7)]
    latest = snapshots.latest_snapshot(series, ["k", "cur_date"], ["v"])
    daily = rows.groupBy("k", summaries.local_day(F.col("ts")).alias("cur_date")).agg(F.sum("v").alias("v"))
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, daily.collect()))


SUMMARY = "cur_date date, org_id string, org_name string, city_id string, city_name string, order_amount decimal(30,2), ts timestamp"


@pytest.mark.parametrize("text", ["20240101", "2024-01-01"])
def test_order_amount(spark, text):
    day = date(2024, 1, 1)
    rows = [(day, "1", "x", "c", "C", Decimal("1.00"), at("2024-01-01 01:00:00")), (day, "1", "x", "c", "C", Decimal("5.00"), at("2024-01-01 02:00:00")),
            (day, "2", "y", "c", "C", Decimal("2.50"), at("2024-01-01 01:00:00")), (date(2024, 1, 2), "1", "x", "c", "C", Decimal("9.00"), at("2024-01-02 01:00:00"))]
    summary = spark.createDataFrame(rows, SUMMARY)
    assert reports.order_amount(summary, text).collect()[0][0] == Decimal("7.50")
    assert reports.order_amount(summary, "20230101").collect()[0][0] is None
    assert reports.order_amount(summary).count() == 1


def test_map_payload(spark):
    report = spark.createDataFrame([("B", 2), ("A", 1)], "province_name string, value bigint")
    row = reports.map_payload(report).first()
    assert [tuple(p) for p in row.map_data] == [("A", 1), ("B", 2)] and row.value_name == "分拣"


def start_days(stream, out, ck):
    totals = events.running_summary(stream, ["k"], {"n": F.count("*")})
    return events.start_summary(totals, out, ["cur_date", "k", "n", "ts"], ck, trigger={"availableNow": True})


@pytest.mark.parametrize("batches", [1, 3])
def test_running_summary_equals_batch(spark, batches):
    root = shared_dir(spark, "test-summary")
    rows = [("ab"[i % 2], at("2024-01-01 12:00:00").timestamp() + i * 977) for i in range(120)]
    schema = "k string, ts double"
    size = len(rows) // batches
    for b in range(batches):
        part = spark.createDataFrame(rows[b * size:(b + 1) * size], schema).withColumn("ts", F.timestamp_seconds("ts"))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{root}/in")
        start_days(stream, f"{root}/out", f"{root}/ck").awaitTermination()
    emitted = events.newest(spark.read.parquet(f"{root}/out"), ["k"])
    want = spark.read.parquet(f"{root}/in").groupBy(summaries.local_day(F.col("ts")).alias("cur_date"), "k").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, emitted.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_of_a_closed_day_are_dropped(spark):
    root = shared_dir(spark, "test-late")
    for part in (["2024-01-01 10:00:00"], ["2024-01-03 10:00:00"], ["2024-01-01 11:00:00", "2024-01-03 09:00:00"]):
        df = spark.createDataFrame([("a", at(t)) for t in part], "k string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{root}/in")
        start_days(stream, f"{root}/out", f"{root}/ck").awaitTermination()
    emitted = events.newest(spark.read.parquet(f"{root}/out"), ["k"])
    assert {(r.cur_date, r.n) for r in emitted.collect()} == {(date(2024, 1, 1), 1), (date(2024, 1, 3), 2)}


def test_fan_out_is_repeatable(spark, tmp_path):
    df = spark.createDataFrame([("sort", "1"), ("inbound", "1"), ("sort", "2")], "fact string, id string")
    for _ in range(2):
        fanout.fan_out(df, str(tmp_path), 0)
    assert {r.id for r in fanout.read_sink(spark, str(tmp_path), "sort").collect()} == {"1", "2"}
    assert fanout.read_sink(spark, str(tmp_path), "inbound").count() == 1


def test_names_are_looked_up_anew_in_every_micro_batch(spark, tmp_path):
    """A dimension row that comes while the stream runs gives its name to the rows that follow."""
    from waybill.plans.streams import as_stream, finish
    from waybill.streaming import jobs

    rows = [(f"2024-01-0{1 + i // 2} 00:00:0{i}", "a", 1.0) for i in range(6)]
    detail = spark.createDataFrame(rows, "t string, cargo_type string, amount double").selectExpr(
        "timestamp(t) as ts", "cargo_type", "cast(amount as decimal(20,2)) as amount")
    calls = []

    def dims():
        calls.append(1)
        names = [("a", f"name {len(calls)}")] if len(calls) > 2 else []
        return {"base_dic": spark.createDataFrame(names, "id string, name string")}

    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = as_stream(spark, detail, "detail", slices=6)
    finish(jobs.start_day_summary("cargo_type_order_day", stream, dims, target, checkpoint, {"availableNow": True}))
    got = spark.read.parquet(target)
    assert got.where("cargo_type_name is null").count() > 0
    last = got.where("cur_date = '2024-01-03'").orderBy(F.desc("ts"), F.desc("order_count")).first()
    assert last.order_count == 2 and last.cargo_type_name in {f"name {n}" for n in range(3, len(calls) + 1)}
