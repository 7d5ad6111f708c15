from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from waybill.functions import masks
from waybill.functions import scalars as S


def one(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return row.select(expression.alias("v")).first()[0]


@pytest.mark.parametrize("name, masked", [("Li", "L*"), ("L", "L"), ("", ""), ("张三丰", "张**"), (None, None)])
def test_mask_name(spark, name, masked):
    row = spark.createDataFrame([(name,)], "n string")
    assert row.select(S.mask_name(F.col("n"))).first()[0] == masked


@pytest.mark.parametrize("phone, valid", [
    ("13812345678", True), ("14012345678", True), ("14212345678", False), ("16612345678", True), ("19412345678", False),
    ("1381234567", False), ("138123456789", False), ("13812345678\n", False), ("x13812345678", False)])
def test_phone(spark, phone, valid):
    assert one(spark, S.is_phone(F.col("p")), p=phone) is valid


@pytest.mark.parametrize("mail, valid", [
    ("a_b-1@mail.example.com", True), ("a@b", False), ("a.b@mail.com", False), ("a@mail.com\n", False), ("@mail.com", False)])
def test_email(spark, mail, valid):
    assert one(spark, S.is_email(F.col("m")), m=mail) is valid


def test_times(spark):
    iso = F.col("t")
    assert one(spark, S.millis(S.instant_of_iso(iso)), t="2024-01-01T00:00:01Z") == 1704067201000
    assert one(spark, S.instant_of_iso(iso), t="rubbish") is None
    # 08:00 on the wall at UTC+8 is midnight UTC.
    assert one(spark, S.millis(S.instant_of_wall_millis(iso)), t=str(1704067200000 + 8 * 3600 * 1000)) == 1704067200000
    assert one(spark, S.instant_of_wall_millis(iso), t="x") is None
    assert one(spark, S.millis(S.instant_of_local_text(iso)), t="2024-01-01 08:00:00") == 1704067200000
    assert one(spark, S.millis(S.instant_of_local_text(iso)), t="2024-01-01") == 1704038400000


@pytest.mark.parametrize("clock, day", [("15:59:59", date(2024, 1, 1)), ("16:00:00", date(2024, 1, 2))])
def test_local_day_turns_at_16_utc(spark, clock, day):
    assert one(spark, S.local_day(F.to_timestamp("t")), t=f"2024-01-01 {clock}") == day


def test_epoch_days_do_not_wrap(spark):
    assert one(spark, S.date_of_epoch_days(F.col("d")), d=30000) == date(2052, 2, 20)


@pytest.mark.parametrize("text", ["20240105", "2024-01-05"])
def test_report_date(text):
    assert S.day_of_report_date(text) == "2024-01-05"


def test_csv_and_payload(spark):
    assert one(spark, S.csv_items(F.col("t")), t="a,b") == ["a", "b"]
    assert one(spark, S.csv_items(F.col("t")), t="") == []
    assert one(spark, S.utf8(F.col("t").cast("binary")), t="é") == "é"
    assert one(spark, S.utf8(F.col("t").cast("binary")), t="") is None


ROWS = {
    "employee_info": ("id string, password string, real_name string, id_card string, phone string",
                      ("1", "secret", "Wang Wu", "110101", "13812345678")),
    "user_info": ("id string, passwd string, real_name string, phone_num string, email string, birthday int",
                  ("1", "secret", "Wang Wu", "999", "w@mail.com", 3650)),
    "truck_info": ("id string, truck_no string, device_gps_id string, engine_no string", ("1", "PLATE-1", "gps-77", "eng-88")),
}


@pytest.mark.parametrize("table", ROWS)
def test_masking_leaves_no_secret_and_keeps_nulls(spark, table):
    schema, values = ROWS[table]
    nulls = (values[0],) + (None,) * (len(values) - 1)
    full, empty = masks.mask_dims(spark.createDataFrame([values, nulls], schema), table).collect()
    assert all(v is None for v in empty[1:])
    secrets = [v for c, v in zip(full.asDict(), values) if c in masks.MASK_RULES[table] and isinstance(v, str)]
    for value in (v for v in full if v):
        assert not any(s in value for s in secrets)


def test_image_and_table_masking_agree(spark):
    for table, (schema, values) in ROWS.items():
        df = spark.createDataFrame([values], schema)
        names = df.columns
        image = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names]))
        by_image = df.select(masks.mask_image(F.lit(table), image).alias("m")).first()["m"]
        assert by_image == masks.mask_dims(df, table).select(*[F.col(n).cast("string") for n in names]).first().asDict()


def test_empty_real_name_stays_empty(spark):
    df = spark.createDataFrame([("",)], "real_name string")
    assert masks.mask_dims(df, "user_info").first()[0] == ""


def test_times_do_not_depend_on_the_session_zone(spark):
    from pyspark.sql import functions as F

    from waybill.functions import scalars as S

    instant = F.timestamp_millis(F.lit(1_704_038_399_123))
    columns = [
        S.millis(S.instant_of_iso(F.lit(t))) for t in ("2024-01-01T08:00:00Z", "2024-01-01 08:00:00", "2024-01-01T16:00:00+08:00", "2024-01-01", "x")
    ] + [S.millis(S.instant_of_local_text(F.lit("2024-01-01 08:00:00"))), S.millis(S.instant_of_local_text(F.lit("2024-01-01")))] + [
        S.local_day(instant).cast("string"), S.text_day(instant), S.text_time(instant)]
    got = []
    for zone in ("UTC", "Asia/Shanghai", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got.append(tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(set(got)) == 1
    noon = 1_704_096_000_000
    assert got[0] == (noon, noon, noon, noon - 28_800_000, None, noon - 28_800_000, noon - 57_600_000, "2023-12-31", "2023-12-31", "2023-12-31 15:59:59")
