"""Masking of personal data, one rule per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions import scalars as S

# Rule of each sensitive column by source table. Columns not listed stay as they are.
MASK_RULES = {
    "employee_info": {"password": "hash", "real_name": "name", "phone": "phone"},
    "express_courier": {"working_phone": "phone"},
    "truck_driver": {"license_no": "hash"},
    "truck_info": {"truck_no": "hash", "device_gps_id": "hash", "engine_no": "hash"},
    "truck_model": {"model_no": "hash"},
    "user_address": {"phone": "phone"},
    "user_info": {
        "passwd": "hash", "real_name": "hash_non_empty", "phone_num": "phone", "email": "email", "birthday": "day",
    },
}

_RULES = {
    "hash": F.md5,
    "hash_non_empty": lambda c: F.when(c == "", c).otherwise(F.md5(c)),
    "name": S.mask_name,
    "phone": lambda c: S.md5_if(S.is_phone(c), c),
    "email": lambda c: S.md5_if(S.is_email(c), c),
    "day": lambda c: S.text_day(S.date_of_epoch_days(c.try_cast("int"))),
}


def mask_dims(df: DataFrame, table: str) -> DataFrame:
    """Mask the columns of one typed dimension table."""
    rules = {c: r for c, r in MASK_RULES.get(table, {}).items() if c in df.columns}
    return df.withColumns({c: _RULES[r](F.col(c).cast("string")) for c, r in rules.items()})


def mask_image(table: Column, image: Column) -> Column:
    """Mask a column -> value map; the table of each row picks the rules, other tables pass as they are."""

    def masked(rules: dict[str, str]) -> Column:
        def value_of(name: Column, value: Column) -> Column:
            out = None
            for column, rule in rules.items():
                out = (F.when if out is None else out.when)(name == column, _RULES[rule](value))
            return out.otherwise(value)

        return F.transform_values(image, value_of)

    out = None
    for source, rules in MASK_RULES.items():
        out = (F.when if out is None else out.when)(table == source, masked(rules))
    return out.otherwise(image)


def mask_order_names(df: DataFrame) -> DataFrame:
    """Sender and receiver of a waybill."""
    return df.withColumns({c: S.mask_name(F.col(c)) for c in ("sender_name", "receiver_name") if c in df.columns})


def mask_trip(df: DataFrame) -> DataFrame:
    """Driver names and number plate of a trip."""
    return df.withColumns({
        "driver1_name": S.mask_name(F.col("driver1_name")),
        "driver2_name": S.mask_name(F.col("driver2_name")),
        "truck_no": F.md5("truck_no"),
    })
