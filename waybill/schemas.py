"""Schemas of the change log and of the tables in it (snake_case wire names)."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _M = T.StringType(), T.IntegerType(), T.LongType(), T.DecimalType(20, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Names and types of the tables on the wire.
ORDER_INFO = _struct(
    id=_S, order_no=_S, status=_S, collect_type=_S, user_id=_S,
    receiver_complex_id=_S, receiver_province_id=_S, receiver_city_id=_S, receiver_district_id=_S, receiver_name=_S,
    sender_complex_id=_S, sender_province_id=_S, sender_city_id=_S, sender_district_id=_S, sender_name=_S,
    payment_type=_S, cargo_num=_I, amount=_M, estimate_arrive_time=_L, distance=_M,
    create_time=_S, update_time=_S, is_deleted=_S,
)

ORDER_CARGO = _struct(
    id=_S, order_id=_S, cargo_type=_S, volumn_length=_I, volumn_width=_I, volumn_height=_I, weight=_M,
    create_time=_S, update_time=_S, is_deleted=_S,
)

ORDER_ORG_BOUND = _struct(
    id=_S, order_id=_S, org_id=_S, status=_S, inbound_time=_S, inbound_emp_id=_S, sort_time=_S, sorter_emp_id=_S,
    outbound_time=_S, outbound_emp_id=_S, create_time=_S, update_time=_S, is_deleted=_S,
)

TRANSPORT_TASK = _struct(
    id=_S, shift_id=_S, line_id=_S, start_org_id=_S, start_org_name=_S, end_org_id=_S, end_org_name=_S,
    order_num=_I, driver1_emp_id=_S, driver1_name=_S, driver2_emp_id=_S, driver2_name=_S, truck_id=_S, truck_no=_S,
    actual_start_time=_S, actual_end_time=_S, actual_distance=_M,
)

CONFIG_DIM = _struct(
    source_table=_S, sink_table=_S, sink_family=_S, sink_columns=_S, sink_pk=_S, foreign_keys=_S,
)

# Dimension images have no fixed columns: the routing row names the wanted ones.
DIM_IMAGE = T.MapType(_S, _S)


def envelope(image: T.DataType = _S) -> T.StructType:
    """Change event; with the default both images stay JSON text. File, position and row say where in the database's log it stood."""
    return _struct(op=_S, before=image, after=image, source=_struct(table=_S, file=_S, pos=_L, row=_I), ts_ms=_L)


# Name of the routing table in the log, unless a call gives another.
CONFIG_TABLE = "config_dim"

# The three table groups of the change log.
TABLE_GROUPS = {
    "dwd": ["order_info", "order_cargo", "transport_task", "order_org_bound"],
    "realtime-dim": [
        "user_info", "user_address", "base_complex", "base_dic", "base_region_info", "base_organ",
        "express_courier", "express_courier_complex", "employee_info", "line_base_shift", "line_base_info",
        "truck_driver", "truck_info", "truck_model", "truck_team",
    ],
    "config": [CONFIG_TABLE],
}
# Where reading of a group starts.
GROUP_START = {"dwd": "latest", "realtime-dim": "initial", "config": "initial"}
